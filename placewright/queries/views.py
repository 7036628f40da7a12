"""Places, questions, hits and turns derived from the base tables; one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLACES = """
SELECT p.p_partkey AS row_id, concat('P', CAST(p.p_partkey AS STRING)) AS place_id,
       concat(p.p_name, ' ', p.p_brand) AS title, p.p_type AS category_name, p.p_brand AS sub_category,
       CASE WHEN p.p_partkey % 97 = 0 THEN NULL
            ELSE CAST(-14500 + ((p.p_partkey * 7919) % 301 - 150) * (CASE WHEN p.p_partkey % 4 = 0 THEN 10 ELSE 1 END) AS DOUBLE) / 10000 END AS lat,
       CASE WHEN p.p_partkey % 97 = 0 THEN NULL
            ELSE CAST(-484900 + ((p.p_partkey * 104729) % 307 - 150) * (CASE WHEN p.p_partkey % 4 = 0 THEN 10 ELSE 1 END) AS DOUBLE) / 10000 END AS lng,
       CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE CAST(1 + p.p_partkey % 4 AS BIGINT) END AS price,
       coalesce(r.reviews, 0) AS reviews, r.rating,
       CASE p.p_partkey % 8
            WHEN 1 THEN 'Monday-Sunday: 8 AM to 12 PM'
            WHEN 2 THEN 'Monday-Thursday: Closed; Friday: 9 PM to 2 AM; Saturday-Sunday: Closed'
            WHEN 3 THEN 'Monday-Sunday: 3 to 9 PM'
            WHEN 4 THEN 'Monday-Friday: Open 24 hours; Saturday-Sunday: Closed'
            WHEN 5 THEN 'Monday-Saturday: 11 AM to 3 PM, 6 PM to 11 PM; Sunday: Closed'
            WHEN 6 THEN 'Tuesday-Sunday: 19:00 to 23:30'
            WHEN 7 THEN 'Invalid format' END AS hours_raw
FROM {part} p LEFT JOIN (
  SELECT l_partkey, count(*) AS reviews, CAST(floor(sum(l_quantity) / count(*)) AS DOUBLE) / 10 AS rating
  FROM {lineitem} GROUP BY l_partkey) r ON r.l_partkey = p.p_partkey
"""
QUESTIONS = """
SELECT c_custkey AS question_id, c_mktsegment AS segment,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(-14500 + ((c_custkey * 31) % 301 - 150) * (CASE WHEN c_custkey % 4 = 0 THEN 10 ELSE 1 END) AS DOUBLE) / 10000 END AS lat,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(-484900 + ((c_custkey * 1747) % 307 - 150) * (CASE WHEN c_custkey % 4 = 0 THEN 10 ELSE 1 END) AS DOUBLE) / 10000 END AS lng,
       CAST(c_custkey % 7 AS INT) AS day_idx, CAST((c_custkey * 613) % 86400 AS BIGINT) AS sec_of_day,
       c_custkey % 3 = 0 AS open_now,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'STANDARD' END AS category,
       CASE WHEN c_custkey % 5 = 0 THEN CAST(2.0 AS DOUBLE) END AS min_rating,
       CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'distance' WHEN 1 THEN 'rating' WHEN 2 THEN 'popularity' ELSE 'best_match' END AS sort_preference,
       c_custkey % 5 <> 2 AS near_me
FROM {customer}
"""
HITS = "SELECT event_id, user_id AS visitor, ts, event_type FROM {events}"
TURNS = """
SELECT user_id AS session_id, event_id AS turn_key, ts,
       CASE WHEN event_type = 'signup' THEN 'bar' WHEN event_type = 'error' THEN 'cafe' END AS category,
       CASE WHEN event_type = 'click' THEN true END AS open_now,
       CASE WHEN event_type = 'purchase' THEN value END AS min_rating,
       CASE WHEN event_type = 'view' THEN 'distance' ELSE 'best_match' END AS sort_preference
FROM {events}
"""
VIEWS = {"v_places": (PLACES, ("part", "lineitem")), "v_questions": (QUESTIONS, ("customer",)), "v_hits": (HITS, ("events",)), "v_turns": (TURNS, ("events",))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def ctes(*names: str) -> str:
    """WITH list of the views for DuckDB, without the WITH."""
    return ",\n".join(f"{n} AS ({VIEWS[n][0].format(**{t: t for t in VIEWS[n][1]})})" for n in names)


HAVERSINE = "6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h))"


def pairs_cte(km: float) -> str:
    """Brute-force pairs of questions and places for the oracle."""
    return f"""{ctes("v_places", "v_questions")},
h AS (SELECT q.*, p.row_id, p.place_id, p.title, p.category_name, p.sub_category, p.price, p.reviews, p.rating, p.hours_raw,
        pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - q.lng) / 2), 2) AS h
      FROM v_questions q, v_places p WHERE q.lat IS NOT NULL AND p.lat IS NOT NULL),
pairs AS (SELECT *, {HAVERSINE} AS km FROM h WHERE {HAVERSINE} <= {km})"""
