"""Work that must not grow as the pairs of large tables do."""

import random
import re

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from placewright.functions.geo import haversine_km
from placewright.functions.text import most_similarity, name_bounds, name_score
from placewright.operators import discs, matching, planning
from placewright.operators import search as operator
from placewright.queries import search


def counted(monkeypatch, module, name, rows):
    """Counts the rows that a function of a module returns."""
    made = getattr(module, name)

    def wrapped(*args, **kwargs):
        out = made(*args, **kwargs)
        rows.append(out.count())
        return out

    monkeypatch.setattr(module, name, wrapped)


def crowd(spark, n: int, copies: int):
    """Places of few names, `copies` at each spot of a small town, and features near them, some under other names."""
    ids = spark.range(n * copies)
    spot = F.col("id") % n
    places = ids.select(
        F.col("id").alias("row_id"), F.concat(F.lit("P"), F.col("id")).alias("place_id"), F.concat(F.lit("Bar Sol "), (spot % 7).cast("string")).alias("title"),
        (spot * 37 % 41 / 20000 - 1.45).alias("p_lat"), (spot * 53 % 43 / 20000 - 48.49).alias("p_lng"),
    )
    features = ids.where("id % 3 = 0").select(
        (F.col("id") + 1).alias("feature_id"), F.concat(F.when(F.col("id") % 9 == 0, "Old ").otherwise(""), F.lit("Bar Sol "), (spot % 7).cast("string")).alias("name"),
        (spot * 37 % 41 / 20000 - 1.45 + spot % 5 / 30000).alias("lat"), (spot * 53 % 43 / 20000 - 48.49).alias("lng"),
    )
    return features, places


def test_matches_of_a_crowd(spark, monkeypatch):
    features, places = crowd(spark, 60, 6)
    score = F.udf(lambda a, b: name_score(a.lower(), b.lower()), "double")
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    pairs = [r for r in features.crossJoin(places).withColumns({"d": km * 1000, "fuzzy": score("name", "title"), "exact": (F.col("name") == F.col("title")).cast("double")}).collect()]
    for threshold in (50.0,):
        for kind in ("exact", "fuzzy"):
            best = {}
            for r in pairs:
                if r.d <= 3 * threshold and r[kind] >= 0.5:
                    key = (-round(0.4 * max(0.0, 1 - r.d / threshold) + 0.6 * r[kind], 12), r.row_id)
                    best[r.feature_id] = min(best.get(r.feature_id, (key, r)), (key, r), key=lambda x: x[0])
            want = {f: r.place_id for f, (_, r) in best.items() if r.d <= threshold and r[kind] >= 0.8 or r.d <= 20 and r[kind] >= 0.6 or r[kind] >= 0.9 and r.d <= 2 * threshold}
            rows = []
            with monkeypatch.context() as patch:
                counted(patch, matching, "near_join", rows)
                got = {r.feature_id: r.place_id for r in matching.best_matches(features, places, threshold, kind == "exact").collect()}
            assert got == want and len(want) > 50
            # all pairs of rows within reach are many more than what is compared
            assert sum(rows) < sum(r.d <= 3 * threshold for r in pairs) / 4


def copied(spark, folder, copies: int) -> str:
    """The small tables, each place and question `copies` times at its location, with other keys."""
    source, period = "/root/testdata/sf0.001", 301 * 307 * 4  # of the coordinates that the views give a key
    shifts = spark.range(copies).select((F.col("id") * period).alias("shift"))
    for table, key in (("part", "p_partkey"), ("customer", "c_custkey"), ("lineitem", "l_partkey")):
        rows = spark.read.parquet(f"{source}/{table}.parquet")
        rows.crossJoin(shifts).withColumn(key, F.col(key) + F.col("shift")).drop("shift").coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_names_that_cannot_win_are_not_scored(spark, monkeypatch):
    """Names of other letters than a feature's own name next to it are no work for letter-by-letter scores."""
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(60)] + ["two  blanks", "two blanks", "açaí"]
    places = spark.createDataFrame([(i, f"P{i}", x, -1.45 + i % 8 / 20000, -48.49 + i // 8 / 20000) for i, x in enumerate(names)], "row_id long, place_id string, title string, p_lat double, p_lng double")
    features = places.select((F.col("row_id") + 1).alias("feature_id"), F.col("title").alias("name"), (F.col("p_lat") + 1e-5).alias("lat"), F.col("p_lng").alias("lng"))
    scored, spread = [], matching.spread
    monkeypatch.setattr(matching, "spread", lambda df, *keys: (scored.append(df.distinct().count()) if keys == ("a", "b") else None, spread(df, *keys))[1])
    got = {r.feature_id: r.place_id for r in matching.best_matches(features, places, 100.0).collect()}
    assert got == {i + 1: f"P{i}" for i in range(len(names))}
    assert 0 < sum(scored) < 150  # of 3,969 pairs of names
    pairs = places.select(F.col("title").alias("a")).crossJoin(places.select(F.col("title").alias("b")))
    pairs = pairs.withColumns({"x": name_bounds("a"), "y": name_bounds("b")}).select("a", "b", most_similarity(F.col("x"), F.col("y")).alias("most"))
    assert all(r.most >= name_score(r.a, r.b) - 1e-12 for r in pairs.collect())



@pytest.mark.parametrize("name", ["near_pairs", "radius_used", "top_places"])
def test_locations_are_searched_once(spark, tmp_path, monkeypatch, name):
    query, sql = search.QUERIES[name]
    made = {}
    for copies in (1, 6):
        folder, rows = copied(spark, tmp_path / str(copies), copies), []
        with monkeypatch.context() as patch:
            counted(patch, search, "near_join", rows)
            counted(patch, operator, "near_join", rows)
            got = sorted(map(tuple, query(spark, folder).collect()))
        con = duckdb.connect()
        for table in ("part", "customer", "lineitem"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        assert got == sorted(con.execute(sql).fetchall())
        made[copies] = sum(rows)
    assert made[1] > 0 and made[6] <= 6 * made[1]


def test_keywords_leave_other_words_behind(spark):
    messages = spark.createDataFrame([(1, "pub crawl in the old town"), (2, "two pubs, one red house"), (3, "red houses and a redhouse"), (4, None), (1, "pub again")], "message_id long, folded string")
    keywords = spark.createDataFrame([("bar", "Pub"), ("bar", "inn"), ("home", "red house"), ("town", "Old Town"), ("tower", "pub")], "label string, keyword string")
    found = planning.scan_keywords(messages, keywords)
    want = [(1, "bar", "pub"), (1, "tower", "pub"), (1, "town", "old town"), (2, "bar", "pub"), (2, "home", "red house"), (2, "tower", "pub"), (3, "home", "red house")]
    assert sorted(map(tuple, found.collect())) == want
    # neither are all word sequences gathered in the memory of the task that reads them, nor dealt by word
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[message_id[^\]]*gram#", plan)
    assert sorted(map(tuple, planning.scan_keywords(messages, keywords, part_phrases=2).collect())) == want


def test_questions_in_a_crowd_meet_locations_not_places(spark):
    """Many places at each location: only some k a question leave the tasks, and they are those that comparing all pairs ranks first."""
    k = 6
    pick = lambda c, n: F.pmod(F.xxhash64("id", F.lit(c)), F.lit(n))
    places = spark.range(3000).select(
        F.col("id").alias("row_id"), (pick("a", 40) / 4000 - 1.45).alias("p_lat"), (pick("b", 40) / 4000 - 48.49).alias("p_lng"), F.when(pick("r", 9) > 0, pick("r", 9) / 2).alias("rating"),
        pick("v", 30).alias("reviews"), F.when(pick("p", 5) > 0, pick("p", 5)).alias("price"), F.when(pick("h", 4) > 0, F.concat(F.lit("h"), pick("h", 4).cast("string"))).alias("hours_raw"),
        F.when(pick("h", 4) > 0, F.array(F.pow(F.lit(2.0), pick("h", 4)).cast("long") + 1)).alias("open_slots"), F.when(pick("c", 7) > 0, F.concat(F.lit("c"), (pick("c", 7) % 3).cast("string"))).alias("category_name"),
        F.when(pick("d", 6) > 0, F.array(F.concat(F.lit("c"), (pick("d", 6) % 3).cast("string")))).alias("categories"),
    )
    pairs = spark.createDataFrame([("c0", "x"), ("c1", "x"), ("c2", "y")], "place_category string, asked string")
    questions = spark.range(200).select(
        F.col("id").alias("question_id"), (pick("a", 44) / 4000 - 1.45).alias("lat"), (pick("b", 44) / 4000 - 48.49).alias("lng"), F.element_at(F.array(*map(F.lit, ("distance", "rating", "popularity", "best_match"))), (F.col("id") % 4 + 1).cast("int")).alias("mode"),
        F.when(pick("c", 3) > 0, F.when(pick("c", 3) == 1, "x").otherwise("y")).alias("category"), (pick("o", 2) == 0).alias("open_now"), F.when(pick("o", 2) == 0, pick("s", 4).cast("int")).alias("slot"),
        F.when(pick("p", 3) == 0, F.lit(2.0)).alias("price_max"), F.when(pick("m", 3) == 0, F.lit(2.0)).alias("min_rating"),
    )
    sorted_places = operator.places_by_category(places, pairs).drop("categories")
    found = discs.best_in_radius(questions, sorted_places, k).cache()
    assert found.groupBy("question_id").count().agg(F.max("count")).first()[0] < 3 * k
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    got = operator.rank(operator.score_columns(found.withColumn("km", km), None), k)
    every = operator.filter_open_at(questions.crossJoin(places.drop("categories")).withColumn("km", km))
    settled = operator.escalate_radius(every.select("question_id", "km", "row_id")).select("question_id", "radius_used").distinct()
    near = operator.by_category(questions.join(settled, "question_id")).join(sorted_places, "asked").withColumn("km", km).where("km <= radius_used")
    left = operator.passed(operator.filter_open_at(near)).withColumn("n_candidates", F.count(F.lit(1)).over(Window.partitionBy("question_id")))
    want = operator.rank(operator.score_columns(left), k)
    columns = ["question_id", "position", "row_id", "secondary_only", "open_status", "n_candidates", F.col("radius_used").cast("double").alias("r")]
    rows = lambda df: sorted(df.select(*columns).collect())
    assert rows(got) == rows(want) and got.count() > 500
