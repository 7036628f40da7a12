"""Queries of sessions, limits and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewright.functions.text import visitor_ip
from placewright.operators import conversations as conv
from placewright.operators import evaluation as ev
from placewright.queries.views import ctes, table, view
from placewright.streaming.limits import chat_batch, hits_to_turns, rate_limit_batch

ZONE = "America/Sao_Paulo"  # three hours behind UTC, all year since 2019


def sessions(spark, sf_dir):
    return conv.sessionize(view(spark, sf_dir, "v_hits")).select("event_id", "visitor", "session_no")


SESSIONS = f"""WITH {ctes('v_hits')}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS nw FROM v_hits WINDOW w AS (PARTITION BY visitor ORDER BY ts, event_id))
SELECT event_id, visitor, CAST(sum(nw) OVER (PARTITION BY visitor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g"""


def merged_turns(spark, sf_dir):
    return conv.merge_turns(view(spark, sf_dir, "v_turns")).select("turn_key", "session_id", "category", F.coalesce("open_now", F.lit(False)).alias("open_now"), "min_rating", "sort_preference")


MERGED_TURNS = f"""WITH {ctes('v_turns')}, r AS (SELECT *, sum(CASE WHEN category IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, turn_key ROWS UNBOUNDED PRECEDING) AS run FROM v_turns)
SELECT turn_key, session_id, last_value(category IGNORE NULLS) OVER w AS category, coalesce(last_value(open_now IGNORE NULLS) OVER w, false) AS open_now, last_value(min_rating IGNORE NULLS) OVER w AS min_rating, sort_preference
FROM r WINDOW w AS (PARTITION BY session_id, run ORDER BY ts, turn_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def budget(spark, sf_dir):
    t = conv.sessionize(view(spark, sf_dir, "v_hits"), idle_s=7 * 86400)
    return conv.turn_budget(t, ("visitor", "session_no"), ("ts", "event_id"), F.col("event_type") != "view").select("event_id", "session_no", "allowed")


BUDGET = f"""WITH {ctes('v_hits')}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 604800000000 THEN 1 ELSE 0 END AS nw FROM v_hits WINDOW w AS (PARTITION BY visitor ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY visitor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)
SELECT event_id, session_no, event_type = 'view' OR sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY visitor, session_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 4 AS allowed FROM s"""


def capped(spark, sf_dir):
    hits = view(spark, sf_dir, "v_hits")
    return conv.daily_cap(hits, 25, ZONE, counts=F.col("event_type") != "error").select("event_id", F.col("local_day").cast("string").alias("local_day"), "allowed")


CAPPED = f"""WITH {ctes('v_hits')}, d AS (SELECT *, CAST(ts - INTERVAL 3 HOUR AS DATE) AS local_day FROM v_hits),
n AS (SELECT event_id, row_number() OVER (PARTITION BY local_day ORDER BY ts, event_id) AS k FROM d WHERE event_type <> 'error')
SELECT d.event_id, CAST(local_day AS VARCHAR) AS local_day, coalesce(k <= 25, false) AS allowed FROM d LEFT JOIN n USING (event_id)"""


def local_clock(spark, sf_dir):
    day, second = conv.local_clock(F.col("ts"), ZONE)
    return view(spark, sf_dir, "v_hits").select("event_id", day.alias("day_idx"), second.alias("sec_of_day"))


LOCAL_CLOCK = f"""WITH {ctes('v_hits')}, l AS (SELECT event_id, ts - INTERVAL 3 HOUR AS t FROM v_hits)
SELECT event_id, CAST(isodow(t) - 1 AS INT) AS day_idx, CAST(hour(t) * 3600 + minute(t) * 60 + second(t) AS BIGINT) AS sec_of_day FROM l"""


def visitors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("9.9.9.9, 10.0.0."), (F.col("user_id") % 300).cast("string"), F.when(F.col("event_id") % 3 == 0, ", fe80::1").otherwise(", 1.2.3.4")).alias("chain"))
    return e.select("event_id", visitor_ip(F.col("chain"), F.lit("127.0.0.1"), 2).alias("second"), visitor_ip(F.col("chain"), F.lit("127.0.0.1"), 1).alias("first"), visitor_ip(F.col("chain"), F.lit("127.0.0.1"), 4).alias("beyond"))


VISITORS = """SELECT event_id, CASE WHEN user_id % 300 <= 255 THEN '10.0.0.' || user_id % 300 ELSE '127.0.0.1' END AS second,
CASE WHEN event_id % 3 = 0 THEN 'fe80::1' ELSE '1.2.3.4' END AS first, '127.0.0.1' AS beyond FROM events"""


# hits one after the other, each with the accepted instants that still count
LIMITED = f"""{ctes('v_hits')},
o AS (SELECT event_id, visitor, epoch_us(ts) AS t, row_number() OVER (PARTITION BY visitor ORDER BY ts, event_id) AS k FROM v_hits),
f AS (SELECT visitor, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS t, CAST([] AS BIGINT[]) AS hits, false AS accepted FROM (SELECT DISTINCT visitor FROM o)
  UNION ALL SELECT visitor, k, event_id, t, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3
  FROM (SELECT o.visitor, o.k, o.event_id, o.t, list_filter(f.hits, lambda x: x > o.t - 86400000000) AS live FROM f JOIN o ON o.visitor = f.visitor AND o.k = f.k + 1))"""
LIMITED_HITS = f"WITH RECURSIVE {LIMITED} SELECT event_id, visitor, accepted, CAST(3 - len(hits) AS INT) AS remaining FROM f WHERE k > 0"
LIMITED_TURNS = f"""WITH RECURSIVE {LIMITED},
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY visitor ORDER BY k) > 1800000000 THEN 1 ELSE 0 END AS nw FROM f WHERE accepted),
s AS (SELECT *, sum(nw) OVER (PARTITION BY visitor ORDER BY k) AS n FROM g)
SELECT visitor, event_id, t AS ts_us, min(t) OVER (PARTITION BY visitor, n) AS session_start, row_number() OVER (PARTITION BY visitor, n ORDER BY k) AS turn,
  row_number() OVER (PARTITION BY visitor, n ORDER BY k) <= 4 AS allowed FROM s"""


def limited_hits(spark, sf_dir):
    return rate_limit_batch(view(spark, sf_dir, "v_hits"), 3, 86400).select("event_id", "visitor", "accepted", "remaining")


def turns(spark, sf_dir):
    return hits_to_turns(view(spark, sf_dir, "v_hits"), 3, 86400)


def chat_pages(spark, sf_dir):
    """Every third hit asks for more of its conversation's last list; a question's list has as many ids as its number has left when divided by 13."""
    hits = view(spark, sf_dir, "v_hits").withColumns({
        "action": F.when(F.col("event_id") % 3 == 0, "more"), "plan": F.concat(F.lit("p"), F.col("event_id").cast("string")),
        "ranked": F.transform(F.slice(F.sequence(F.lit(1), F.lit(13)), 1, (F.col("event_id") % 13).cast("int")), lambda i: F.col("event_id") * 100 + i),
    })
    found = chat_batch(hits, 1_000_000, 600, 2, 20 * 86400)
    return found.select("event_id", "status", "turn", "plan", F.array_join("page", ",").alias("page"), "has_more")


CHAT_PAGES = f"""WITH {ctes('v_hits')}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1728000000000 THEN 1 ELSE 0 END AS nw FROM v_hits WINDOW w AS (PARTITION BY visitor ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY visitor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ses FROM g),
q AS (SELECT *, event_id % 3 <> 0 AS ask, count_if(event_id % 3 <> 0) OVER (PARTITION BY visitor, ses ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS asks FROM s),
r AS (SELECT *, ask AND asks <= 2 AS answered, least(asks, 2) AS turn FROM q),
l AS (SELECT *, last_value(CASE WHEN answered THEN event_id END IGNORE NULLS) OVER (PARTITION BY visitor, ses ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS src,
  count_if(NOT ask) OVER (PARTITION BY visitor, ses, turn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mores FROM r),
p AS (SELECT *, src % 13 AS n, CASE WHEN answered THEN 0 ELSE mores * 5 END AS begin FROM l),
o AS (SELECT *, CASE WHEN answered THEN 'answered' WHEN ask THEN 'finished' WHEN coalesce(n, 0) = 0 THEN 'no_results' ELSE 'page' END AS status FROM p)
SELECT event_id, status, CAST(turn AS BIGINT) AS turn, CASE WHEN status IN ('answered', 'page') THEN 'p' || src END AS plan,
  CASE WHEN status IN ('answered', 'page') THEN array_to_string(list_transform(range(CAST(begin + 1 AS BIGINT), CAST(least(begin + 5, n) + 1 AS BIGINT)), lambda i: src * 100 + i), ',') ELSE '' END AS page,
  status IN ('answered', 'page') AND begin + 5 < n AS has_more FROM o"""


def predictions(spark, sf_dir):
    """A rule's language for each document, with two expected labels on some."""
    text = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    rule = F.when(text.contains(" the "), "en").when(text.contains(" der "), "de").when(text.contains(" que "), F.when(text.contains(" los "), "es").otherwise("fr")).otherwise("")
    expected = F.when(F.col("doc_id") % 10 == 0, F.array("lang", F.lit("fr"))).otherwise(F.array("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.array_distinct(expected).alias("expected"), rule.alias("predicted"), text.contains(" and ").alias("a"), text.contains(" of ").alias("b"))


PREDICTIONS = """p AS (SELECT doc_id, lang, source, n_chars, list_distinct(CASE WHEN doc_id % 10 = 0 THEN [lang, 'fr'] ELSE [lang] END) AS expected,
  CASE WHEN contains(t, ' the ') THEN 'en' WHEN contains(t, ' der ') THEN 'de' WHEN contains(t, ' que ') THEN CASE WHEN contains(t, ' los ') THEN 'es' ELSE 'fr' END ELSE '' END AS predicted,
  contains(t, ' and ') AS a, contains(t, ' of ') AS b FROM (SELECT *, ' ' || lower(text) || ' ' AS t FROM documents))"""


def prf(spark, sf_dir):
    return ev.label_prf(predictions(spark, sf_dir))


PRF = f"""WITH {PREDICTIONS}, g AS (SELECT unnest(expected) AS label, predicted FROM p),
t AS (SELECT label, count(*) FILTER (predicted = label) AS tp, count(*) FILTER (predicted <> label) AS fn, count(*) AS support FROM g GROUP BY label),
w AS (SELECT predicted AS label, count(*) AS fp FROM p WHERE predicted <> '' AND NOT list_contains(expected, predicted) GROUP BY predicted),
x AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(support, 0) AS support FROM t FULL JOIN w USING (label)),
y AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM x)
SELECT label, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1, support FROM y"""


def confused(spark, sf_dir):
    return ev.confusion(predictions(spark, sf_dir))


CONFUSED = f"WITH {PREDICTIONS} SELECT list_sort(expected)[1] AS gold, CASE WHEN predicted = '' THEN '(empty)' ELSE predicted END AS predicted, count(*) AS n FROM p GROUP BY ALL"


def accuracy(spark, sf_dir):
    return ev.accuracy_rollup(predictions(spark, sf_dir).withColumn("correct", F.array_contains("expected", F.col("predicted"))), ("lang", "source"))


ACCURACY = f"""WITH {PREDICTIONS}, c AS (SELECT *, list_contains(expected, predicted)::INT AS ok FROM p)
SELECT 'all' AS dimension, 'all' AS value, count(*) AS n, round(avg(ok), 6) AS accuracy FROM c
UNION ALL SELECT 'lang', lang, count(*), round(avg(ok), 6) FROM c GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(ok), 6) FROM c GROUP BY source"""


def percentiles(spark, sf_dir):
    return ev.nearest_rank_pct(table(spark, sf_dir, "documents"), "n_chars", "lang")


PERCENTILES = """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n_chars) FILTER (i = round_even(50 / 100 * (n - 1), 0)) AS p50, max(n_chars) FILTER (i = round_even(95 / 100 * (n - 1), 0)) AS p95 FROM r GROUP BY lang"""


def agreed(spark, sf_dir):
    return ev.agreement(predictions(spark, sf_dir), "a", "b")


AGREED = f"WITH {PREDICTIONS} SELECT count(*) FILTER (a AND b) AS \"both\", count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second, count(*) FILTER (NOT a AND NOT b) AS neither, round(avg((a = b)::INT), 6) AS rate FROM p"


def benchmark(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.select(F.col("event_type").alias("model"), (F.col("event_id") % 4).alias("n_results"), (F.col("event_id") % 3 > 0).alias("grounded"), (F.col("event_id") % 7 == 0).alias("failed"), F.col("value").alias("latency_ms"))
    return ev.benchmark_summary(runs)


BENCHMARK = """SELECT event_type AS model, count(*) AS n, round(avg((event_id % 3 > 0 AND event_id % 7 <> 0)::INT), 6) AS grounded_share,
round(quantile_cont(value, 0.5) FILTER (event_id % 7 <> 0), 6) AS median_ms FROM events WHERE event_id % 4 > 0 GROUP BY event_type"""


def grounded(spark, sf_dir):
    """Every question of the part table names its own part and, for every fifth, another one."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" "), "p_brand").alias("title"))
    other = p.select((F.col("k") - 1).alias("k"), F.col("title").alias("other"))
    base = p.join(other, "k")
    answers = base.select(F.col("k").alias("answer_id"), F.when(F.col("k") % 10 == 0, F.concat(F.lit("near "), F.col("other"))).otherwise("").alias("question"),
                          F.concat(F.lit("Try **"), F.col("title"), F.lit("**, it is open"), F.when(F.col("k") % 5 == 0, F.concat(F.lit(", or go to "), F.col("other"), F.lit("!"))).otherwise(".")).alias("answer"))
    return ev.grounding(answers, p.select(F.col("k").alias("answer_id"), "title"), p.select("title"), exact=True)


GROUNDED = """WITH p AS (SELECT p_partkey AS k, p_name || ' ' || p_brand AS title FROM part), b AS (SELECT p.k, p.title, o.title AS other FROM p JOIN p o ON o.k = p.k + 1)
SELECT k AS answer_id, NOT (k % 5 = 0 AND k % 10 <> 0 AND title <> other) AS grounded FROM b"""

QUERIES = {
    "sessions": (sessions, SESSIONS), "merged_turns": (merged_turns, MERGED_TURNS), "turn_budget": (budget, BUDGET), "daily_cap": (capped, CAPPED), "local_clock": (local_clock, LOCAL_CLOCK),
    "visitor_ip": (visitors, VISITORS), "rate_limited_hits": (limited_hits, LIMITED_HITS), "limited_turns": (turns, LIMITED_TURNS), "chat_pages": (chat_pages, CHAT_PAGES), "label_prf": (prf, PRF), "confusion": (confused, CONFUSED),
    "accuracy_rollup": (accuracy, ACCURACY), "nearest_rank_percentiles": (percentiles, PERCENTILES), "detector_agreement": (agreed, AGREED), "benchmark_summary": (benchmark, BENCHMARK),
    "grounding": (grounded, GROUNDED),
}
