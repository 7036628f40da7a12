"""Queries of the message planning, over messages made of the base tables' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewright.functions.text import fold
from placewright.operators import planning as plan
from placewright.queries.views import table

# messages with the wordings that the rules look for, dealt over the rows of customer
PHRASES = [
    "Restaurantes abertos perto de mim", "best cheap sushi near me open now", "hotel aberto hoje, nota acima de 4", "bar com preço até 50 e 100 reviews", "compare parks at least 20 reviews", "Olá! farmácia 24h",
    "excelente pizzaria no meu bairro", "closed now or open right now?", "luxo rating >= 4.5", "what is open at 9 h", "pub aberto domingo", "4.5+ café perto da praça", "just some words", "aberto agora domingo",
]
CASES = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))
MESSAGES = f"SELECT c_custkey AS message_id, concat(CASE CAST(c_custkey % {len(PHRASES)} AS INT) {CASES} END, ' ', lower(c_mktsegment), ' ', CAST(c_custkey AS STRING)) AS text FROM {{customer}}"
FOLDED = f"m AS (SELECT *, lower(trim(strip_accents(text))) AS f FROM ({MESSAGES.format(customer='customer')}))"


def messages(spark, sf_dir):
    return spark.sql(MESSAGES, customer=table(spark, sf_dir, "customer"))


def any_of(phrases) -> str:
    return "(" + " OR ".join(f"contains(f, '{p}')" for p in phrases) + ")"


def words_of(words) -> str:
    return f"regexp_matches(f, '\\b({'|'.join(words)})\\b')"


def number(patterns) -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(f, '{p}', 1), '') AS DOUBLE)" for p in patterns) + ")"


def gated(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return plan.gate_messages(rows).select("conv_id", "turn", "reason", "clean", "explanation")


GATED = r"""WITH g AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM conversations WHERE role = 'user'),
r AS (SELECT *, CASE WHEN length(text) > 1600 THEN 'too_long' WHEN NOT regexp_full_match(text, '[\p{L}\p{N} ,.:?!]*') THEN 'bad_chars' WHEN c = '' THEN 'empty' WHEN length(c) > 400 THEN 'too_long' END AS reason FROM g)
SELECT conv_id, turn, reason, CASE WHEN reason IS NULL THEN c END AS clean, CASE reason WHEN 'too_long' THEN 'A question can be at most 400 characters long.'
WHEN 'bad_chars' THEN 'Use only letters, digits, spaces and the marks , . : ? !' WHEN 'empty' THEN 'Type a question.' END AS explanation FROM r"""


def languages(spark, sf_dir):
    explicit = F.when(F.col("message_id") % 5 == 0, F.when(F.col("message_id") % 10 == 0, "pt_BR").otherwise("fr"))
    return messages(spark, sf_dir).select("message_id", plan.detect_language(F.col("text")).alias("detected"), plan.detect_language(F.col("text"), explicit).alias("language"))


PT = "list_has_any(regexp_extract_all(f, '[\\p{L}\\p{N}_]+'), [" + ", ".join(f"'{w}'" for w in plan.PT_WORDS) + "])"
LANGUAGES = f"""WITH {FOLDED} SELECT message_id, CASE WHEN {PT} THEN 'pt-BR' ELSE 'en' END AS detected,
CASE WHEN message_id % 10 = 0 THEN 'pt-BR' WHEN message_id % 5 = 0 THEN 'en' WHEN {PT} THEN 'pt-BR' ELSE 'en' END AS language FROM m"""


def plans(spark, sf_dir):
    p = plan.plan_messages(messages(spark, sf_dir), F.col("message_id") % 2 == 0)
    return p.select(
        "message_id", "intent", "category", "place_type", F.coalesce("open_now", F.lit(False)).alias("open_now"), "price_max", "min_rating", F.coalesce("min_reviews", F.lit(-1)).alias("min_reviews"), "near_me", "sort_preference",
        F.array_join("keywords", "|").alias("keywords"), F.array_join("signals", "|").alias("signals"),
    )


STOPS = ", ".join(f"'{w}'" for w in plan.STOP_WORDS)
ROUTE = " ".join(f"WHEN {any_of(words)} THEN '{name}'" for name, words in plan.ROUTES)
TERM = " ".join(f"WHEN contains(f, '{p}') THEN {v}" for p, v in plan.RATING_TERMS)
TYPE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in plan.PLACE_TYPES.items())
# RE2 has no lookahead: hours other than 24 by enumeration
OTHER = plan.OTHER_TIME.replace(r"\b(?!24)\d{1,2}\s*h\b", r"\b(\d|[013-9]\d|2[0-35-9])\s*h\b")
PLANS = f"""WITH {FOLDED},
s AS (SELECT *, CASE {ROUTE} ELSE 'find_places' END AS intent,
  CASE WHEN {any_of(('bar', 'pub'))} THEN 'bar' WHEN {any_of(('hotel', 'motel'))} THEN 'hotel' WHEN {any_of(('park', 'parque'))} THEN 'tourist_attraction' ELSE 'restaurant' END AS category,
  ((NOT {any_of(plan.CLOSED_PHRASES)} AND {any_of(plan.OPEN_PHRASES)}) OR regexp_matches(f, '\\babert[oa]s?\\b')) AND NOT (regexp_matches(f, '{OTHER}') AND NOT regexp_matches(f, '{plan.NOW_WORDS}')) AS open_now,
  coalesce({number(plan.PRICE_PATTERNS)}, CASE WHEN {any_of(plan.CHEAP)} THEN 2.0 WHEN {any_of(plan.LUXURY)} THEN 4.0 END) AS price_max,
  coalesce({number(plan.RATING_PATTERNS)}, CASE {TERM} END) AS min_rating, CAST({number(plan.REVIEW_PATTERNS)} AS BIGINT) AS min_reviews,
  {any_of(plan.NEAR_PHRASES)} OR {words_of(plan.NEAR_WORDS)} OR {any_of(('near', 'close', 'perto'))} AS near_me,
  list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({STOPS}) AND length(w) > 2)[1:10] AS kw FROM m),
t AS (SELECT *, CASE category {TYPE} END AS place_type, CASE WHEN near_me AND message_id % 2 = 0 THEN 'distance' ELSE 'best_match' END AS sort_preference FROM s)
SELECT message_id, intent, category, place_type, open_now, price_max, min_rating, coalesce(min_reviews, -1) AS min_reviews, near_me, sort_preference, array_to_string(kw, '|') AS keywords,
  concat_ws('|', 'place_type=' || place_type, CASE WHEN open_now THEN 'open_now=true' END, CASE WHEN price_max <> 0 THEN 'price_max=' || CAST(price_max AS VARCHAR) END,
  CASE WHEN min_rating <> 0 THEN 'min_rating=' || CAST(min_rating AS VARCHAR) END, CASE WHEN sort_preference <> 'best_match' THEN 'sort=distance' END) AS signals FROM t"""

LEXICON = [("en", "food", "the and"), ("en", "food", "of the"), ("fr", "drink", "de la"), ("fr", "drink", "que"), ("de", "stay", "in der"), ("es", "stay", "de los"), ("en", "short", "on")]
KEYWORDS = [("category", "bar", "Bar"), ("category", "bar", "pub"), ("category", "food", "restaurante"), ("category", "food", "sushi"), ("category", "park", "park"), ("category", "health", "farmácia"), ("category", "build", "building"), ("category", "home", "house hold")]


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


def lexicon_hits(spark, sf_dir):
    lexicon = spark.createDataFrame(LEXICON, "lang string, category string, phrase string")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("message_id"), fold(F.col("text")).alias("folded"))
    return plan.scan_lexicon(turns, lexicon)


LEXICON_HITS = f"""WITH l(lang, category, phrase) AS (VALUES {values(LEXICON)}) SELECT DISTINCT conv_id || '-' || turn AS message_id, category, phrase
FROM conversations, l WHERE contains(lower(trim(strip_accents(text))), phrase)"""


def keyword_hits(spark, sf_dir):
    keywords = spark.createDataFrame(KEYWORDS, "kind string, label string, keyword string")
    return plan.scan_keywords(messages(spark, sf_dir).withColumn("folded", fold(F.col("text"))), keywords)


KEYWORD_HITS = f"""WITH {FOLDED}, k(kind, label, keyword) AS (VALUES {values(KEYWORDS)})
SELECT DISTINCT message_id, label, lower(keyword) AS keyword FROM (SELECT *, ' ' || regexp_replace(f, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ' AS w FROM m), (SELECT *, lower(strip_accents(keyword)) AS n FROM k), (VALUES (''), ('s'), ('es')) e(x) WHERE contains(w, ' ' || n || x || ' ')"""


def united_terms(spark, sf_dir):
    hits = keyword_hits(spark, sf_dir)
    terms = hits.select("message_id", F.col("keyword").alias("term"), F.concat(F.lit("1"), "label").alias("ord")).unionByName(hits.select("message_id", F.upper("label").alias("term"), F.concat(F.lit("2"), "label").alias("ord")))
    return plan.union_terms(terms).select("message_id", F.array_join("terms", "|").alias("terms"))


UNITED = f"""WITH {FOLDED}, k(kind, label, keyword) AS (VALUES {values(KEYWORDS)}),
h AS (SELECT DISTINCT message_id, label, lower(keyword) AS keyword FROM (SELECT *, ' ' || regexp_replace(f, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ' AS w FROM m), (SELECT *, lower(strip_accents(keyword)) AS n FROM k), (VALUES (''), ('s'), ('es')) e(x) WHERE contains(w, ' ' || n || x || ' ')),
t AS (SELECT message_id, keyword AS term, '1' || label AS ord FROM h UNION ALL SELECT message_id, upper(label), '2' || label FROM h),
d AS (SELECT message_id, lower(strip_accents(term)) AS f, min((ord, term)) AS t FROM t GROUP BY ALL)
SELECT message_id, string_agg(t[2], '|' ORDER BY t) AS terms FROM d GROUP BY message_id"""


def chips(spark, sf_dir):
    p = plan.plan_messages(messages(spark, sf_dir))
    c = F.when(F.col("message_id") % 4 == 0, "Sorvete").when(F.col("message_id") % 4 == 1, "açaí").otherwise(F.col("category"))
    return p.select("message_id", F.array_join(plan.follow_up_chips(c, F.col("open_now"), F.col("near_me"), F.col("min_rating"), F.col("message_id") % 3 == 0), "|").alias("chips"))


CHIPS = f"""WITH p AS ({PLANS}),
k AS (SELECT *, CASE CAST(message_id % 4 AS INT) WHEN 0 THEN 'cafe' WHEN 1 THEN 'ice_cream' ELSE CASE category WHEN 'restaurant' THEN 'cafe' ELSE 'restaurant' END END AS s1 FROM p),
s AS (SELECT *, CASE s1 WHEN 'cafe' THEN 'acai' WHEN 'ice_cream' THEN 'cafe' ELSE 'cafe' END AS s2 FROM k),
l AS (SELECT message_id, list_filter([CASE WHEN NOT open_now THEN 'Open now' END, CASE WHEN message_id % 3 = 0 AND NOT near_me THEN 'Closest to me' END,
  CASE s1 WHEN 'cafe' THEN 'Cafés' WHEN 'ice_cream' THEN 'Ice cream' ELSE 'Restaurants' END, CASE WHEN coalesce(min_rating, 0) = 0 THEN 'Top rated' END,
  CASE s2 WHEN 'acai' THEN 'Açaí' WHEN 'cafe' THEN 'Cafés' END], lambda x: x IS NOT NULL) AS c FROM s)
SELECT message_id, array_to_string(c[1:3], '|') AS chips FROM l"""

# a model's labels by hand: every third message has none
SCORED = """SELECT message_id, kind, label, confidence FROM (
SELECT message_id, 'intent' AS kind, 'popularity' AS label, CASE CAST(message_id % 5 AS INT) WHEN 0 THEN 0.6 WHEN 1 THEN 0.28 WHEN 2 THEN 0.31 ELSE 0.1 END AS confidence FROM {m} WHERE message_id % 3 <> 0
UNION ALL SELECT message_id, 'intent', 'business_hours', CASE WHEN message_id % 5 = 2 THEN 0.5 ELSE 0.25 END FROM {m} WHERE message_id % 3 = 1
UNION ALL SELECT message_id, 'intent', 'location', CASE WHEN message_id % 7 = 0 THEN 0.35 ELSE 0.2 END FROM {m} WHERE message_id % 3 = 2
UNION ALL SELECT message_id, 'category', CASE WHEN message_id % 4 = 0 THEN 'bar' ELSE 'food' END, 0.5 FROM {m} WHERE message_id % 3 <> 0
UNION ALL SELECT message_id, 'category', CASE WHEN message_id % 4 = 0 THEN 'food' ELSE 'park' END, CASE WHEN message_id % 2 = 0 THEN 0.3 ELSE 0.29 END FROM {m} WHERE message_id % 3 <> 0) s"""


def scored_labels(spark, sf_dir):
    return spark.sql(SCORED, m=messages(spark, sf_dir)).withColumn("confidence", F.col("confidence").cast("double"))


def scored_plans(spark, sf_dir):
    p = plan.plan_messages(messages(spark, sf_dir), F.col("message_id") % 2 == 0, scored=scored_labels(spark, sf_dir))
    return p.select("message_id", "category", F.coalesce("open_now", F.lit(False)).alias("open_now"), "near_me", "sort_preference")


# the model's part written out: thresholds of 0.3, and what rules say where it is silent
SCORED_PLANS = f"""WITH {FOLDED}, rule AS ({PLANS.replace('WITH ' + FOLDED + ',', 'WITH')}),
c AS (SELECT *, message_id % 3 <> 0 AS known, CASE CAST(message_id % 5 AS INT) WHEN 0 THEN 0.6 WHEN 1 THEN 0.28 WHEN 2 THEN 0.31 ELSE 0.1 END AS pop,
  CASE WHEN message_id % 3 = 1 THEN CASE WHEN message_id % 5 = 2 THEN 0.5 ELSE 0.25 END ELSE 0 END AS hrs, CASE WHEN message_id % 3 = 2 THEN CASE WHEN message_id % 7 = 0 THEN 0.35 ELSE 0.2 END ELSE 0 END AS loc FROM m),
d AS (SELECT c.*, r.category AS rule_category, r.open_now AS rule_open, {any_of(plan.NEAR_PHRASES)} OR {words_of(plan.NEAR_WORDS)} AS said_near, r.near_me AS rule_near,
  CASE WHEN pop >= hrs AND pop >= loc THEN 'popularity' WHEN hrs >= loc THEN 'business_hours' ELSE 'location' END AS top, greatest(pop, hrs, loc) AS most FROM c JOIN rule r USING (message_id)),
e AS (SELECT *, CASE WHEN known THEN said_near OR loc >= 0.3 ELSE rule_near END AS near FROM d)
SELECT message_id, CASE WHEN NOT known THEN rule_category WHEN message_id % 4 = 0 THEN 'bar' ELSE 'food' END AS category,
  rule_open OR (known AND hrs >= 0.3 AND {any_of(plan.OPEN_WORDS)} AND NOT {any_of(plan.CLOSED_WORDS)} AND NOT (regexp_matches(f, '{OTHER}') AND NOT regexp_matches(f, '{plan.NOW_WORDS}'))) AS open_now, near AS near_me,
  CASE WHEN near AND message_id % 2 = 0 THEN 'distance' WHEN known AND (top = 'popularity' AND most >= 0.3 OR top = 'business_hours' AND pop >= 0.3) THEN 'popularity'
  WHEN known AND top = 'popularity' AND {any_of(("best", "top", "melhor", "rating", "rated", "nota", "avaliado"))} THEN 'rating' ELSE 'best_match' END AS sort_preference FROM e"""


def category_terms(spark, sf_dir):
    keywords = spark.createDataFrame([(i, label, k) for i, (_, label, k) in enumerate(KEYWORDS)], "ord int, label string, keyword string")
    lexicon = spark.createDataFrame([("food", "near me"), ("bar", "aberto agora"), ("park", "4.5")], "category string, phrase string")
    found = plan.extract_categories(messages(spark, sf_dir).withColumn("folded", fold(F.col("text"))), keywords, lexicon, scored_labels(spark, sf_dir))
    return found.select("message_id", F.array_join("terms", "|").alias("terms"))


CATEGORY_TERMS = f"""WITH {FOLDED}, k(o, label, keyword) AS (VALUES {", ".join(f"({i}, '{label}', '{k}')" for i, (_, label, k) in enumerate(KEYWORDS))}),
w AS (SELECT *, ' ' || regexp_replace(f, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ' AS words FROM m),
n AS (SELECT *, lower(strip_accents(keyword)) AS fk FROM k),
s AS ({SCORED.format(m="m")}),
t AS (SELECT message_id, lower(keyword) AS term, 1 AS src, 0.0 AS rk, o FROM w, n WHERE contains(words, ' ' || fk || ' ') OR contains(words, ' ' || fk || 's ') OR contains(words, ' ' || fk || 'es ')
  UNION ALL SELECT message_id, lower(keyword), 2, 0.0, o FROM m, n WHERE label = 'food' AND contains(f, 'near me') OR label = 'bar' AND contains(f, 'aberto agora') OR label = 'park' AND contains(f, '4.5')
  UNION ALL SELECT message_id, lower(keyword), 3, -confidence, o FROM s JOIN n USING (label) WHERE kind = 'category' AND confidence >= 0.3 AND confidence < 0.5),
d AS (SELECT message_id, lower(strip_accents(term)) AS g, min((src, rk, o, term)) AS x FROM t GROUP BY ALL)
SELECT message_id, string_agg(x[4], '|' ORDER BY x) AS terms FROM d GROUP BY message_id"""

QUERIES = {
    "scored_plans": (scored_plans, SCORED_PLANS), "category_terms": (category_terms, CATEGORY_TERMS),
    "gated_messages": (gated, GATED), "languages": (languages, LANGUAGES), "message_plans": (plans, PLANS), "lexicon_hits": (lexicon_hits, LEXICON_HITS), "keyword_hits": (keyword_hits, KEYWORD_HITS),
    "united_terms": (united_terms, UNITED), "follow_up_chips": (chips, CHIPS),
}
