"""The chat job over the conversations table, and whole evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewright.operators import planning as plan
from placewright.operators import search
from placewright.plans.chat import chat_answers
from placewright.plans.evaluate import evaluate_answers, evaluate_plans, golden_questions
from placewright.plans.validate import validation
from placewright.queries.limits import ACCURACY, PERCENTILES, PREDICTIONS, PRF, predictions
from placewright.queries.matching import FEATURES, HAVERSINE
from placewright.queries.planning import CASES, OTHER, PHRASES, any_of, number, words_of
from placewright.queries.search import BOUNDS, INTERVALS, places
from placewright.queries.views import ctes, table, view

# user turns with wordings that the rules look for, and what a message may bring besides
MESSAGES = f"""SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id, {{ts}} AS ts,
  concat(CASE CAST((conv_id * 5 + turn * 3) % {len(PHRASES)} AS INT) {CASES} END, CASE WHEN conv_id % 7 = 0 THEN ' @' ELSE '  ' END, CAST(turn AS STRING)) AS text,
  CASE WHEN (conv_id + turn) % 5 = 4 THEN 'more' END AS action, CASE WHEN conv_id % 4 = 0 THEN 'en' END AS language,
  CASE WHEN conv_id % 3 = 1 THEN CAST(-14500 + ((conv_id * 31) % 301 - 150) AS DOUBLE) / 10000 WHEN conv_id % 6 = 2 THEN CAST(10.0 AS DOUBLE) END AS lat,
  CASE WHEN conv_id % 3 = 1 THEN CAST(-484900 + ((conv_id * 1747) % 307 - 150) AS DOUBLE) / 10000 WHEN conv_id % 6 = 2 THEN CAST(-48.5 AS DOUBLE) END AS lng,
  CASE WHEN (conv_id + turn) % 9 = 0 THEN CAST(2.0 AS DOUBLE) END AS given_min_rating, CASE WHEN conv_id % 11 = 0 THEN false END AS given_open_now
FROM {{conversations}} WHERE role = 'user'"""
KEYWORDS = [(0, "bar", "bar"), (1, "bar", "pub"), (2, "restaurant", "sushi"), (3, "restaurant", "pizzaria"), (4, "cafe", "café"), (5, "park", "parks")]
#: Words of the part table's types that match what is asked for.
MATCHES = [("bar", "STANDARD"), ("bar", "SMALL"), ("pub", "SMALL"), ("sushi", "ECONOMY"), ("pizzaria", "PROMO"), ("café", "MEDIUM"), ("restaurant", "LARGE"), ("other", "SMALL"), ("park", "PROMO")]
ZONE = "America/Sao_Paulo"  # three hours behind UTC, all year since 2019


def chat(spark, sf_dir):
    ts = "timestamp_seconds(1704067200 + (conv_id * 7919 + turn * 3607) % 604800 + turn * 700000)"
    messages = spark.sql(MESSAGES.format(ts=ts, conversations="{conversations}"), conversations=table(spark, sf_dir, "conversations"))
    keywords = spark.createDataFrame(KEYWORDS, "ord int, label string, keyword string")
    pairs = spark.createDataFrame(MATCHES, "asked string, place_category string")
    found = chat_answers(messages, places(spark, sf_dir), pairs, keywords, BOUNDS, "Norte", ZONE)
    return found.select("message_id", "status", "reason", "language", "answer", F.array_join("place_ids", ",").alias("place_ids"), "has_more", "turns_left", F.array_join("follow_ups", "|").alias("follow_ups"))


def listed(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


ROUTE_TYPES = "CASE WHEN {bar} THEN 'bar' WHEN {hotel} THEN 'other' WHEN {park} THEN 'park' ELSE 'restaurant' END"
TERM = " ".join(f"WHEN contains(f, '{p}') THEN {v}" for p, v in plan.RATING_TERMS)
SLOTS = ("place_type", "open_now", "price_max", "min_rating", "lat", "lng", "near_me", "categories")
INHERIT = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in SLOTS)
LINE = """string_agg(concat(position, '. ', title, ' (', category_name, ')', CASE WHEN km IS NOT NULL THEN concat(' - ', printf('%.2f', km), 'km away') ELSE '' END,
  CASE WHEN rating <> 0 THEN concat(' - Rating: ', printf('%.1f', rating), '/5') ELSE '' END, CASE WHEN reviews <> 0 THEN concat(' (', reviews, ' reviews)') ELSE '' END,
  CASE open_status WHEN 'open' THEN {open} WHEN 'unknown' THEN {unknown} ELSE '' END), chr(10) ORDER BY position)"""
EN, PT = search.ANSWER["en"], search.ANSWER["pt-BR"]
quoted = lambda text: "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
CHAT = f"""WITH {ctes('v_places')}, {INTERVALS},
m AS ({MESSAGES.format(ts="make_timestamp(CAST((1704067200 + (conv_id * 7919 + turn * 3607) % 604800 + turn * 700000) * 1000000 AS BIGINT))", conversations="conversations")}),
g AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, action IS NOT DISTINCT FROM 'more' AS more,
  CASE WHEN NOT regexp_matches(text, '^[\\p{{L}}\\p{{N}} ,.:?!]*$') THEN 'bad_chars' END AS reason FROM m),
n AS (SELECT *, NOT more AND reason IS NULL AS ask, count_if(NOT more AND reason IS NULL) OVER (PARTITION BY session_id ORDER BY ts, message_id ROWS UNBOUNDED PRECEDING) AS asked FROM g),
k AS (SELECT *, CASE WHEN more THEN 'more' WHEN NOT ask THEN 'rejected' WHEN asked <= 4 THEN 'answered' ELSE 'finished' END AS kind, greatest(4 - asked, 0) AS turns_left FROM n),
t AS (SELECT *, last_value(CASE WHEN kind = 'answered' THEN message_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, message_id ROWS UNBOUNDED PRECEDING) AS source,
  CASE WHEN more THEN 1 + count_if(more) OVER (PARTITION BY session_id, least(asked, 4) ORDER BY ts, message_id ROWS UNBOUNDED PRECEDING) ELSE 1 END AS page FROM k),
a AS (SELECT *, lower(trim(strip_accents(clean))) AS f, coalesce(lat BETWEEN -1.6 AND -1.4 AND lng BETWEEN -48.6 AND -48.4, false) AS here FROM t WHERE kind = 'answered'),
p AS (SELECT *, ' ' || regexp_replace(f, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ' AS words,
  CASE WHEN language IS NOT NULL THEN 'en' WHEN len(list_intersect(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}_]+'), {list(plan.PT_WORDS)})) > 0 THEN 'pt-BR' ELSE 'en' END AS said,
  {ROUTE_TYPES.format(bar=any_of(('bar', 'pub')), hotel=any_of(('hotel', 'motel')), park=any_of(('park', 'parque')))} AS kind_of,
  ((NOT {any_of(plan.CLOSED_PHRASES)} AND {any_of(plan.OPEN_PHRASES)}) OR regexp_matches(f, '\\babert[oa]s?\\b')) AND NOT (regexp_matches(f, '{OTHER}') AND NOT regexp_matches(f, '{plan.NOW_WORDS}')) AS says_open,
  coalesce({number(plan.PRICE_PATTERNS)}, CASE WHEN {any_of(plan.CHEAP)} THEN 2.0 WHEN {any_of(plan.LUXURY)} THEN 4.0 END) AS says_price,
  coalesce(given_min_rating, {number(plan.RATING_PATTERNS)}, CASE {TERM} END) AS says_rating,
  {any_of(plan.NEAR_PHRASES)} OR {words_of(plan.NEAR_WORDS)} OR {any_of(('near', 'close', 'perto'))} AS says_near FROM a),
kw(o, label, keyword) AS (VALUES {listed(KEYWORDS)}),
c AS (SELECT message_id, list(keyword ORDER BY o) AS cats FROM p, kw WHERE contains(words, ' ' || strip_accents(keyword) || ' ') OR contains(words, ' ' || strip_accents(keyword) || 's ') OR contains(words, ' ' || strip_accents(keyword) || 'es ') GROUP BY message_id),
s AS (SELECT session_id, p.message_id, ts, said, here, lat IS NOT NULL AND NOT here AND says_near AS outside, CASE WHEN says_near AND here THEN 'distance' ELSE 'best_match' END AS sort_preference,
  cats AS categories, kind_of AS place_type, CASE WHEN coalesce(given_open_now, says_open) THEN true END AS open_now, says_price AS price_max, says_rating AS min_rating,
  CASE WHEN says_near AND here THEN lat END AS lat, CASE WHEN says_near AND here THEN lng END AS lng, CASE WHEN says_near THEN true END AS near_me FROM p LEFT JOIN c USING (message_id)),
r AS (SELECT *, count_if(categories IS NOT NULL) OVER (PARTITION BY session_id ORDER BY ts, message_id ROWS UNBOUNDED PRECEDING) AS run FROM s),
q AS (SELECT session_id, message_id, said, here, outside, sort_preference, (isodow(ts - INTERVAL 3 HOUR) - 1)::INT AS day_idx, (hour(ts - INTERVAL 3 HOUR) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS sec_of_day, {INHERIT}
  FROM r WINDOW w AS (PARTITION BY session_id, run ORDER BY ts, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x(asked, word) AS (VALUES {listed(MATCHES)}),
ok AS (SELECT DISTINCT message_id, word FROM (SELECT message_id, unnest(coalesce(categories, [place_type])) AS asked FROM q) JOIN x USING (asked)),
opened AS (SELECT DISTINCT message_id, i.hours_raw FROM q JOIN iv i ON (i.day = q.day_idx AND CASE WHEN i.end_s < i.start_s THEN q.sec_of_day >= i.start_s ELSE q.sec_of_day BETWEEN i.start_s AND i.end_s END
          OR i.day = (q.day_idx + 6) % 7 AND i.end_s < i.start_s AND q.sec_of_day < i.end_s)),
e AS (SELECT q.message_id, q.said, q.sort_preference, q.near_me, q.open_now, q.price_max, q.min_rating, v.row_id, v.place_id, v.title, v.category_name, v.sub_category, v.price, v.reviews, v.rating, v.hours_raw,
  pow(sin(radians(v.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lng - q.lng) / 2), 2) AS h, q.lat IS NOT NULL AND q.near_me IS NOT NULL AS near FROM q, v_places v),
b AS (SELECT e.*, {HAVERSINE} AS km, CASE WHEN open_now IS NULL THEN NULL WHEN o.hours_raw IS NOT NULL THEN 'open' WHEN e.hours_raw IS NULL THEN 'unknown' ELSE 'closed' END AS open_status
  FROM e LEFT JOIN opened o ON o.message_id = e.message_id AND o.hours_raw = e.hours_raw),
stay AS (SELECT * FROM b WHERE open_status IS DISTINCT FROM 'closed'),
around AS (SELECT message_id, CASE WHEN count_if(km <= 0.5) >= 5 THEN 0.5 WHEN count_if(km <= 1) >= 5 THEN 1.0 ELSE 2.0 END AS radius FROM stay WHERE near GROUP BY message_id),
fit AS (SELECT stay.*, w1.word IS NULL AS secondary_only FROM stay LEFT JOIN around USING (message_id) LEFT JOIN ok w1 ON w1.message_id = stay.message_id AND w1.word = category_name
  LEFT JOIN ok w2 ON w2.message_id = stay.message_id AND w2.word = sub_category
  WHERE (NOT near OR km <= radius) AND (w1.word IS NOT NULL OR w2.word IS NOT NULL) AND (price_max IS NULL OR price IS NULL OR price <= price_max) AND (min_rating IS NULL OR coalesce(rating >= min_rating, false))),
far AS (SELECT *, (10 * 3.5 + reviews * coalesce(rating, 0)) / (10 + reviews) AS pop, max(km) OVER (PARTITION BY message_id) AS most FROM fit),
rk AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY secondary_only, CASE WHEN open_status = 'unknown' THEN 1 ELSE 0 END,
  CASE sort_preference WHEN 'distance' THEN -coalesce(km, 'inf'::DOUBLE) ELSE round(0.45 * (coalesce(rating, 0) / 5) + 0.35 * (pop / 5) + 0.20 * coalesce(1 - km / CASE WHEN most > 0 THEN most ELSE 1 END, 0), 9) END DESC,
  CASE sort_preference WHEN 'distance' THEN coalesce(rating, 0) ELSE 0 END DESC, row_id) AS position FROM far),
top AS (SELECT message_id AS source, list(place_id ORDER BY position) AS ids FROM rk WHERE position <= 30 GROUP BY message_id),
txt AS (SELECT message_id, {LINE.format(open="CASE said WHEN 'en' THEN ' - open' ELSE ' - aberto' END", unknown="CASE said WHEN 'en' THEN ' - hours unknown' ELSE ' - horário desconhecido' END")} AS body FROM rk WHERE position <= 5 GROUP BY message_id),
sib AS (SELECT q.*, CASE list_filter(coalesce(categories, []), lambda z: strip_accents(z) IN ('bar', 'cafe', 'restaurant'))[1] WHEN 'bar' THEN 'restaurant' WHEN 'café' THEN 'acai' ELSE 'restaurant' END AS s1 FROM q),
z AS (SELECT q.message_id AS source, q.said, q.outside, body,
  list_filter([CASE WHEN open_now IS NULL THEN CASE said WHEN 'en' THEN 'Open now' ELSE 'Abertos agora' END END, CASE WHEN here AND near_me IS NULL THEN CASE said WHEN 'en' THEN 'Closest to me' ELSE 'Mais perto de mim' END END,
    CASE s1 WHEN 'acai' THEN 'Açaí' ELSE CASE said WHEN 'en' THEN 'Restaurants' ELSE 'Restaurantes' END END, CASE WHEN coalesce(min_rating, 0) = 0 THEN CASE said WHEN 'en' THEN 'Top rated' ELSE 'Mais bem avaliados' END END,
    CASE s1 WHEN 'acai' THEN CASE said WHEN 'en' THEN 'Ice cream' ELSE 'Sorveterias' END ELSE 'Cafés' END], lambda y: y IS NOT NULL)[1:3] AS chips FROM sib q LEFT JOIN txt USING (message_id)),
o AS (SELECT t.*, z.said, z.outside, z.body, z.chips, CASE WHEN kind IN ('answered', 'more') THEN coalesce(ids, []) ELSE [] END AS ids FROM t LEFT JOIN z USING (source) LEFT JOIN top USING (source))
SELECT message_id, CASE WHEN kind = 'more' THEN CASE WHEN len(ids) = 0 THEN 'no_results' ELSE 'page' END ELSE kind END AS status, reason, CASE WHEN kind = 'answered' THEN said END AS language,
  CASE WHEN kind = 'answered' THEN CASE WHEN outside THEN CASE said WHEN 'en' THEN 'Searching near you only works in Norte, and you don''t seem to be here. These are places from across the city.'
      ELSE 'A busca por proximidade só funciona em Norte, e você não parece estar aqui. Estes são lugares de toda a cidade.' END || chr(10) || chr(10) ELSE '' END ||
    CASE WHEN body IS NULL THEN CASE said WHEN 'en' THEN {quoted(EN[3])} ELSE {quoted(PT[3])} END ELSE CASE said WHEN 'en' THEN {quoted(EN[0])} || body || {quoted(EN[1])} ELSE {quoted(PT[0])} || body || {quoted(PT[1])} END END
    WHEN kind = 'more' AND len(ids) > 0 THEN CASE language WHEN 'en' THEN 'More places from your last search.' ELSE 'Mais lugares da sua última busca.' END END AS answer,
  array_to_string(ids[CAST((page - 1) * 5 + 1 AS BIGINT):CAST(page * 5 AS BIGINT)], ',') AS place_ids, len(ids) > page * 5 AS has_more, CAST(turns_left AS BIGINT) AS turns_left,
  CASE WHEN kind = 'answered' THEN array_to_string(chips, '|') END AS follow_ups FROM o"""


def plan_scores(spark, sf_dir):
    """All parts of an evaluation of plans, one row for each figure."""
    scores = evaluate_plans(predictions(spark, sf_dir).withColumn("language", F.col("lang")), ("language", "source"), "n_chars")
    row = lambda part, key, *names: F.explode(F.array(*[F.struct(F.lit(part).alias("part"), key.alias("key"), F.lit(n).alias("figure"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")
    parts = [
        scores.labels.select(row("label", F.col("label"), "tp", "fp", "fn", "precision", "recall", "f1", "support")),
        scores.confusion.select(row("confusion", F.concat_ws(">", "gold", "predicted"), "n")),
        scores.accuracy.select(row("accuracy", F.concat_ws("=", "dimension", "value"), "n", "accuracy")),
        scores.latency.select(row("latency", F.col("language"), "p50", "p95")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("r.*")


def figures(part: str, key: str, sql: str, *names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{part}' AS part, {key} AS key, '{n}' AS figure, CAST({n} AS DOUBLE) AS value FROM ({sql})" for n in names)


PLAN_SCORES = " UNION ALL ".join([
    figures("label", "label", PRF, "tp", "fp", "fn", "precision", "recall", "f1", "support"),
    figures("confusion", "gold || '>' || predicted", f"WITH {PREDICTIONS} SELECT list_sort(expected)[1] AS gold, CASE WHEN predicted = '' THEN '(empty)' ELSE predicted END AS predicted, count(*) AS n FROM p GROUP BY ALL", "n"),
    figures("accuracy", "dimension || '=' || value", ACCURACY.replace("'lang'", "'language'"), "n", "accuracy"),
    figures("latency", "lang", PERCENTILES, "p50", "p95"),
])


def answer_scores(spark, sf_dir):
    """Answers of three models that name a part's own title, or another's, judged and summed up by model."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" "), "p_brand").alias("title"))
    other = p.select((F.col("k") - 1).alias("k"), F.col("title").alias("other"))
    answers = p.join(other, "k").select(
        F.col("k").alias("answer_id"), F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("model"), F.lit("").alias("question"),
        F.concat(F.lit("Try **"), F.col("title"), F.lit("**"), F.when(F.col("k") % 5 == 0, F.concat(F.lit(", or "), F.col("other"), F.lit("!"))).otherwise(F.concat(F.lit(" -, "), F.replace("other", F.lit(" "), F.lit(", "))))).alias("answer"),
        (F.col("k") % 100).cast("double").alias("latency_ms"), (F.col("k") % 7 == 0).alias("failed"),
    )
    results = p.where("k % 4 > 0").select(F.col("k").alias("answer_id"), "title")
    return evaluate_answers(answers, results, p.select("title"), exact=True)[1]


ANSWER_SCORES = """WITH p AS (SELECT p_partkey AS k, p_name || ' ' || p_brand AS title FROM part), b AS (SELECT p.k, p.title, o.title AS other FROM p JOIN p o ON o.k = p.k + 1)
SELECT 'm' || k % 3 AS model, count(*) AS n, round(avg((NOT (k % 5 = 0 AND title <> other) AND k % 7 <> 0)::INT), 6) AS grounded_share, round(quantile_cont(CAST(k % 100 AS DOUBLE), 0.5) FILTER (k % 7 <> 0), 6) AS median_ms
FROM b WHERE k % 4 > 0 GROUP BY ALL"""


def golden(spark, sf_dir):
    """Two golden sets as one bag, repeated rows included."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") % 50).alias("id"), F.char_length("text").alias("size"))
    return golden_questions({"pt-BR": turns.where("id % 2 = 0"), "en": turns.where("id % 3 = 0")}).groupBy("language", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


GOLDEN = """WITH t AS (SELECT conv_id % 50 AS id, length(text) AS size FROM conversations WHERE role = 'user')
SELECT language, id, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM (SELECT 'pt-BR' AS language, * FROM t WHERE id % 2 = 0 UNION ALL SELECT 'en', * FROM t WHERE id % 3 = 0) GROUP BY ALL"""


def validated(spark, sf_dir):
    """Report and mismatches of a validation by equal names; features lie farther away the higher their number."""
    v = view(spark, sf_dir, "v_places")
    features = spark.sql(FEATURES, v_places=v).withColumns({"lat": F.col("lat") + F.col("feature_id") % 4 / 2000, "osm_type": F.lit("node"), "osm_id": F.col("feature_id")})
    out = validation(v.select("row_id", "place_id", "title", "lat", "lng"), features, 500.0, exact=True)
    report = out.report.select(F.lit("report").alias("part"), F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in out.report.columns])).alias("r")).select("part", "r.*")
    return report.unionByName(out.mismatches.select(F.lit("mismatch").alias("part"), F.concat_ws("|", "place_id", "title", "osm_name", "osm_id").alias("key"), F.col("distance_m").alias("value")))


VALIDATED = f"""WITH {ctes("v_places")}, ft AS (SELECT * REPLACE (lat + feature_id % 4 / 2000 AS lat) FROM ({FEATURES.format(v_places="v_places")})), pl AS (SELECT * FROM v_places WHERE lat IS NOT NULL),
h AS (SELECT feature_id, f.name, p.place_id, p.title, p.row_id, pow(sin(radians(p.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - f.lng) / 2), 2) AS h
  FROM ft f JOIN pl p ON lower(f.name) = lower(p.title)),
c AS (SELECT *, {HAVERSINE} * 1000 AS d FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY round(0.4 * greatest(0, 1 - d / 500) + 0.6, 12) DESC, row_id) AS n FROM c WHERE d <= 1500),
a AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY feature_id) AS k FROM b WHERE n = 1 AND d <= 1000),
w AS (SELECT * FROM a WHERE k = 1),
s AS (SELECT (SELECT count(*) FROM ft)::DOUBLE AS features, (SELECT count(*) FROM pl)::DOUBLE AS places, (SELECT count(*) FROM w)::DOUBLE AS verified, (SELECT count(*) FROM w WHERE d > 150)::DOUBLE AS mismatches)
SELECT 'report' AS part, unnest(['features', 'places', 'verified', 'unverified', 'match_rate', 'mismatches']) AS key, unnest([features, places, verified, places - verified, round(verified / places, 3), mismatches]) AS value FROM s
UNION ALL SELECT 'mismatch', concat_ws('|', place_id, title, name, 'node/' || feature_id), round(d, 1) FROM w WHERE d > 150"""

QUERIES = {"chat_answers": (chat, CHAT), "plan_scores": (plan_scores, PLAN_SCORES), "answer_scores": (answer_scores, ANSWER_SCORES), "golden_questions": (golden, GOLDEN), "map_validation": (validated, VALIDATED)}
