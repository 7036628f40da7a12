"""Queries of the catalog build, over an export derived from part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewright.operators import catalog as ops
from placewright.plans.catalog import build_catalog
from placewright.queries.views import PLACES, table
from placewright.sources.files import clean_repairs

CITY = ops.City("São Luís", "MA", ("São Luís", "Ribamar", "Raposa"), (-1.55, -1.35, -48.6, -48.4))

EXPORT = f"""
SELECT v.row_id * 2 + d.k AS row_id, CASE WHEN v.row_id % 50 = 0 THEN '' ELSE v.place_id END AS "placeId",
  CASE v.row_id % 6 WHEN 0 THEN upper(v.title) WHEN 1 THEN concat('bar de ', lower(v.title)) WHEN 2 THEN replace(v.title, 'a', '?') WHEN 3 THEN concat(' ', v.title, ' ') ELSE v.title END AS title,
  CASE WHEN v.row_id % 9 = 0 THEN '' WHEN v.row_id % 4 = 1 THEN 'Snack bar' ELSE v.category_name END AS "categoryName",
  CASE v.row_id % 4 WHEN 0 THEN 'Pub' WHEN 1 THEN 'Bar' WHEN 2 THEN 'Barber shop' ELSE v.category_name END AS "categories/0",
  CASE WHEN d.k = 1 THEN 'Jardim Público' ELSE '' END AS "categories/1",
  CASE WHEN v.row_id % 3 = 0 THEN concat('Rua ', v.place_id) ELSE '' END AS address,
  CASE WHEN v.row_id % 3 = 1 THEN concat('Av. ', v.place_id) ELSE '' END AS "formattedAddress",
  '' AS neighborhood,
  CASE v.row_id % 5 WHEN 0 THEN 'São Luís' WHEN 1 THEN 'S?o Lu?s' WHEN 2 THEN 'RIBAMAR' WHEN 3 THEN 'Alcântara' ELSE ' Raposa ' END AS city,
  CASE WHEN v.row_id % 2 = 0 THEN 'MA' ELSE 'Maranhão' END AS state,
  coalesce(CAST(v.lat AS STRING), 'n/a') AS "location/lat", coalesce(CAST(v.lng AS STRING), '') AS "location/lng",
  '' AS phone, '' AS website, '' AS url, '' AS price, coalesce(CAST(v.rating AS STRING), '') AS "totalScore",
  CASE WHEN v.row_id % 13 = 0 THEN '' ELSE concat(CAST(v.reviews + d.k * (v.row_id % 3 - 1) AS STRING), '.0') END AS "reviewsCount",
  CASE WHEN v.row_id % 10 = 0 THEN 'Yes' ELSE 'No' END AS "isSponsored",
  CASE WHEN v.row_id % 29 = 0 THEN concat(coalesce(v.hours_raw, ''), ' dtype: object') ELSE coalesce(v.hours_raw, '') END AS "businessTime"
FROM ({PLACES}) v CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) d WHERE d.k = 0 OR v.row_id % 7 = 0
"""
REPAIRS = """SELECT concat('P', CAST(p_partkey AS STRING)) AS place_id, CASE WHEN p_partkey % 8 = 0 THEN '?' ELSE concat(p_name, ' ', p_brand) END AS title,
  CASE WHEN p_partkey % 3 = 0 THEN 'b.csv' ELSE 'a.csv' END AS file, p_partkey AS row_id FROM {part} WHERE p_partkey % 12 <> 2"""


def export(spark, sf_dir):
    return spark.sql(EXPORT.replace('"', "`"), part=table(spark, sf_dir, "part"), lineitem=table(spark, sf_dir, "lineitem"))


def repairs(spark, sf_dir):
    return clean_repairs(spark.sql(REPAIRS, part=table(spark, sf_dir, "part")))


def _catalog(spark, sf_dir):
    return build_catalog(export(spark, sf_dir), repairs(spark, sf_dir), CITY)


def catalog(spark, sf_dir):
    c = _catalog(spark, sf_dir)[0]
    return c.withColumn("categories", F.array_join("categories", "|")).drop("phone", "website", "url", "neighborhood")


FOLD = "lower(trim(strip_accents({0})))"
TYPES = ", ".join(f"('{w.replace('é', 'e').replace('ç', 'c')}', {i}, '{k}')" for i, (k, w) in enumerate((k, w) for k, ws in ops.TYPE_WORDS.items() for w in ws))
SMALL = ", ".join(f"'{w}'" for w in ops.SMALL_WORDS)
# place types by joining words with candidates, the other way round from the column expression
CATALOG_CTES = f"""
e AS ({EXPORT.format(part="part", lineitem="lineitem")}),
rep AS (SELECT place_id, title FROM ({REPAIRS.format(part="part")}) WHERE title <> '?'),
c AS (SELECT row_id, nullif("placeId", '') AS place_id, trim(title) AS title_raw, nullif("categoryName", '') AS category_name,
   list_filter(["categories/0", "categories/1"], lambda x: x <> '') AS listed,
   coalesce(nullif(address, ''), nullif("formattedAddress", '')) AS address, address = '' AND "formattedAddress" <> '' AS address_from_alt, trim(city) AS city_raw, state AS state_raw,
   TRY_CAST("location/lat" AS DOUBLE) AS lat, TRY_CAST("location/lng" AS DOUBLE) AS lng, TRY_CAST("totalScore" AS DOUBLE) AS rating,
   coalesce(CAST(TRY_CAST("reviewsCount" AS DOUBLE) AS BIGINT), 0) AS reviews, "isSponsored" = 'Yes' AS is_sponsored, nullif(trim("businessTime"), '') AS hours FROM e),
c2 AS (SELECT *, CASE WHEN category_name IS NULL OR list_contains(listed, category_name) THEN listed ELSE list_prepend(category_name, listed) END AS cats FROM c),
idd AS (SELECT * FROM c2 WHERE place_id IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY reviews DESC, row_id) AS rn, count(*) OVER (PARTITION BY place_id) AS n, min(row_id) OVER (PARTITION BY place_id) AS first_row FROM idd),
flat AS (SELECT place_id, rn, row_id, unnest(cats) AS cat, generate_subscripts(cats, 1) AS pos FROM best),
firsts AS (SELECT place_id, cat, min((CASE WHEN rn = 1 THEN 0 ELSE 1 END, row_id, pos)) AS seen FROM flat GROUP BY place_id, cat),
merged_cats AS (SELECT place_id, list(cat ORDER BY seen) AS cats FROM firsts GROUP BY place_id),
k AS (SELECT b.* EXCLUDE (cats), coalesce(m.cats, []) AS cats FROM best b LEFT JOIN merged_cats m USING (place_id) WHERE rn = 1),
words(word, pref, kind) AS (VALUES {TYPES}),
cand AS (SELECT place_id, 0 AS pos, category_name AS cand FROM k WHERE category_name IS NOT NULL UNION ALL SELECT place_id, generate_subscripts(cats, 1), unnest(cats) FROM k),
hit AS (SELECT place_id, pos, kind, pref, len(string_split(word, ' ')) AS n FROM cand JOIN words ON contains(' ' || array_to_string(regexp_extract_all({FOLD.format('cand')}, '[a-z0-9]+'), ' ') || ' ', ' ' || word || ' ')),
typed AS (SELECT place_id, arg_min(kind, (pos, -n, pref)) AS place_type FROM hit GROUP BY place_id),
f AS (SELECT k.*, coalesce(t.place_type, 'other') AS place_type,
   NOT (({FOLD.format('city_raw')} IN ('sao luis', 'ribamar', 'raposa') OR city_raw = 'S?o Lu?s') AND (lat IS NULL OR lng IS NULL OR (lat BETWEEN -1.55 AND -1.35 AND lng BETWEEN -48.6 AND -48.4))) AS outside,
   contains(title_raw, '?') AS bad, r.title AS fixed FROM k LEFT JOIN typed t USING (place_id) LEFT JOIN rep r USING (place_id)),
g AS (SELECT *, CASE WHEN bad AND fixed IS NOT NULL THEN fixed ELSE title_raw END AS t0 FROM f),
cleaned AS (SELECT *, CASE WHEN (t0 = lower(t0) AND t0 <> upper(t0)) OR (t0 = upper(t0) AND t0 <> lower(t0) AND contains(t0, ' ')) THEN
   array_to_string(list_transform(string_split(lower(t0), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ({SMALL}) THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ') ELSE t0 END AS title,
   CASE WHEN contains(hours, 'dtype: object') THEN 'garbage' WHEN hours IS NULL OR hours = 'Invalid format' THEN 'unknown' ELSE 'parsed' END AS hours_status FROM g)"""
CATALOG = f"""WITH {CATALOG_CTES}
SELECT first_row AS row_id, place_id, title, title_raw, array_to_string(cats, '|') AS categories, category_name, place_type, address, 'São Luís' AS city, 'MA' AS state, lat, lng,
  CASE WHEN reviews <> 0 THEN rating END AS rating, reviews, is_sponsored, CASE WHEN hours_status <> 'garbage' THEN hours END AS hours_raw, hours_status, bad AND fixed IS NULL AS needs_review
FROM cleaned WHERE NOT outside"""


def report(spark, sf_dir):
    return _catalog(spark, sf_dir)[1]


REPORT = f"""WITH {CATALOG_CTES},
i AS (SELECT * FROM cleaned WHERE NOT outside)
SELECT (SELECT count(*) FROM e) AS input_rows, (SELECT count(*) FROM e WHERE "placeId" = '') AS null_place_id_dropped, (SELECT count(*) FROM i) AS kept,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM cleaned) AS merged_duplicates, (SELECT count(*) FROM cleaned WHERE outside) AS outside_municipality_dropped,
  (SELECT count(*) FROM i WHERE city_raw <> 'São Luís' OR state_raw <> 'MA') AS city_state_normalized, (SELECT count(*) FROM i WHERE address_from_alt) AS addresses_unified,
  (SELECT count(*) FROM i WHERE bad AND fixed IS NOT NULL) AS titles_repaired_from_raw, (SELECT count(*) FROM i WHERE bad AND fixed IS NULL) AS titles_flagged_needs_review,
  (SELECT count(*) FROM i WHERE title <> t0) AS titles_title_cased, (SELECT count(*) FROM i WHERE hours_status = 'parsed') AS hours_parsed, (SELECT count(*) FROM i WHERE hours_status <> 'parsed') AS hours_unknown,
  (SELECT count(*) FROM i WHERE hours_status = 'garbage') AS hours_garbage_cleared, (SELECT count(*) FROM i WHERE reviews = 0 AND rating IS NOT NULL) AS zero_review_ratings_nulled,
  (SELECT count(*) FROM i WHERE is_sponsored) AS sponsor_flags_unified,
  (SELECT count(*) FROM e WHERE "placeId" = '') + (SELECT count(*) FROM cleaned WHERE outside) AS dropped"""


def search_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("place_id"), F.col("p_name").alias("title"))
    terms = table(spark, sf_dir, "part").select(F.upper(F.substring_index("p_name", " ", 2)).alias("query")).distinct()
    return ops.title_search(p, terms)


SEARCH_TITLES = r"""WITH t AS (SELECT DISTINCT 'P' || p_partkey AS place_id, p_name AS title, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part),
q AS (SELECT DISTINCT upper(array_to_string(string_split(p_name, ' ')[1:2], ' ')) AS query FROM part)
SELECT query, place_id, title FROM q, t WHERE list_has_all(w, regexp_extract_all(lower(query), '[a-z0-9]+'))"""


def repaired_titles(spark, sf_dir):
    return repairs(spark, sf_dir)


REPAIRED = f"SELECT place_id, title FROM ({REPAIRS.format(part='part')}) WHERE title <> '?'"


def serving_view(spark, sf_dir):
    s = ops.serving(_catalog(spark, sf_dir)[0])
    return s.groupBy("place_type", "city").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_lat"), 6).alias("sum_lat"), F.sum("reviews").alias("reviews"), F.count("price").alias("priced"))


SERVING = f"""WITH {CATALOG_CTES} SELECT place_type, 'São Luís' AS city, count(*) AS n, round(sum(lat), 6) AS sum_lat, CAST(sum(reviews) AS BIGINT) AS reviews, CAST(0 AS BIGINT) AS priced
FROM cleaned WHERE NOT outside GROUP BY place_type"""

QUERIES = {"catalog": (catalog, CATALOG), "cleaning_report": (report, REPORT), "title_search": (search_titles, SEARCH_TITLES), "title_repairs": (repaired_titles, REPAIRED), "serving_view": (serving_view, SERVING)}
