"""The cell index against brute force, lists of categories, the phrase automaton, split dumps, versions of a catalog, streams out of order, and evaluations."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from placewright.functions import geo
from placewright.operators import conversations, evaluation, matching, place_index, planning, search
from placewright.plans import answer
from placewright.plans.validate import validation
from placewright.sources import files
from placewright.streaming import limits, ordered

PLACE = "row_id long, place_id string, p_lat double, p_lng double, categories array<string>, category_name string, price long, reviews long, rating double, hours_raw string"
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def some_places(rng, n, texts):
    tags = ["Bar", "Cafe", "Pub", "Park", "Inn"]
    rows = []
    for i in range(n):
        at = (round(-1.45 + rng.gauss(0, 0.05), 4), round(-48.5 + rng.gauss(0, 0.05), 4)) if rng.random() < 0.95 else rng.choice([(None, None), (40.0, 179.99), (-1.45, None)])
        own = rng.sample(tags, rng.choice([0, 1, 1, 2]))
        rows.append((i, f"P{i}", *at, own, rng.choice([own[0] if own else "Bar", None]), rng.choice([1, 2, 3, 4, None]), rng.choice([0, 5, 100]), rng.choice([3.0, 4.0, 4.5, None]), rng.choice([*texts, None, " "])))
    return rows


def some_questions(rng, n):
    rows = []
    for i in range(n):
        at = (round(-1.45 + rng.gauss(0, 0.08), 4), round(-48.5 + rng.gauss(0, 0.08), 4)) if rng.random() < 0.8 else (None, None)
        asked = rng.choice([None, [], ["bar"], ["bar", "cafe"], ["cafe", "bar"], ["nothing"]])
        rows.append((i, *at, rng.random() < 0.2, rng.randrange(7), rng.randrange(86_400), rng.random() < 0.4, asked, rng.choice([None, 2.0]), rng.choice([None, 3.5, 4.5]), rng.choice(["distance", "rating", "popularity", "best_match"])))
    return rows


QUESTION = "question_id long, lat double, lng double, near_me boolean, day_idx int, sec_of_day long, open_now boolean, category array<string>, price_max double, min_rating double, sort_preference string"
PAIRS = [("Bar", "bar"), ("Pub", "bar"), ("Cafe", "cafe")]


def brute_answers(spark, questions, places, intervals, k):
    """Every question against every place, by the rules as they are written."""
    from placewright.functions.hours import is_open, with_week

    pairs = spark.createDataFrame(PAIRS, "c string, a string")
    of = {}
    for r in pairs.collect():
        of.setdefault(r.a, set()).add(r.c)
    every = with_week(places, intervals).crossJoin(questions).withColumn("km", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")))
    every = every.withColumn("open", is_open(F.col("week"), F.col("day_idx"), F.col("sec_of_day"))).drop("week")
    out = {}
    by = {}
    for r in every.collect():
        by.setdefault(r.question_id, []).append(r)
    for q, rows in by.items():
        first = rows[0]
        located = first.lat is not None and first.lng is not None
        if first.sort_preference == "distance" and not located:
            continue
        keep = []
        for r in rows:
            status = None
            if r.open_now:
                status = "open" if r.open else "unknown" if not (r.hours_raw or "").strip() else "closed"
            if status != "closed":
                keep.append((r, status))
        radius = None
        if located and first.near_me:
            within = lambda km: [x for x in keep if x[0].km is not None and x[0].km <= km]
            radius = next((km for km in (0.5, 1.0) if len(within(km)) >= 5), 2.0)
            keep = within(radius)
        wanted = set().union(*[of.get(a, set()) for a in first.category]) if first.category else None
        keep = [(r, s) for r, s in keep if (wanted is None or not r.categories or wanted & set(r.categories)) and (r.price_max is None or r.price is None or r.price <= r.price_max)
                and (r.min_rating is None or (r.rating is not None and r.rating >= r.min_rating))]
        far = max([r.km for r, _ in keep if r.km is not None], default=None)
        ranked = []
        for r, s in keep:
            secondary = wanted is not None and r.category_name is not None and r.category_name not in wanted
            rating = r.rating or 0.0
            popular = (35 + r.reviews * rating) / (10 + r.reviews)
            near = 0.0 if r.km is None or far is None else 1 - r.km / (far if far > 0 else 1.0)
            value = {"distance": (-(r.km if r.km is not None else float("inf")), rating), "rating": (rating, r.reviews), "popularity": (round(popular, 9), 0)}.get(
                r.sort_preference, (round(0.45 * (rating / 5) + 0.35 * (popular / 5) + 0.2 * near, 9), 0))
            ranked.append(((secondary, s == "unknown", -value[0], -value[1], r.row_id), r.place_id, s, secondary))
        ranked.sort(key=lambda x: x[0])
        out[q] = [(i + 1, place, s, secondary, len(ranked), radius) for i, (_, place, s, secondary) in enumerate(ranked[:k])]
    return out


def test_answers_equal_brute_force(spark, monkeypatch):
    from placewright.functions.hours import parse_hours

    rng = random.Random(21)
    # texts by the hundred, so that nearly each question about open places has filters of its own
    texts = [f"{DAYS[rng.randrange(5)]}-Sunday: {rng.randrange(1, 12)}:{rng.randrange(60):02} AM to {rng.randrange(1, 12)}:{rng.randrange(60):02} PM" for _ in range(400)]
    places = spark.createDataFrame(some_places(rng, 1_500, texts), PLACE)
    questions = spark.createDataFrame(some_questions(rng, 120), QUESTION)
    pairs = spark.createDataFrame(PAIRS, "place_category string, asked string")
    sizes = {}
    monkeypatch.setattr(place_index, "written", lambda df, name, real=place_index.written: sizes.setdefault((name, len(sizes)), real(df, name)))
    got = {}
    for r in answer.answer_questions(questions, places, pairs, k=7).orderBy("question_id", "position").collect():
        got.setdefault(r.question_id, []).append((r.position, r.place_id, r.open_status, r.secondary_only, r.n_candidates, r.radius_used))
    want = {q: rows for q, rows in brute_answers(spark, questions, places, parse_hours(places), 7).items() if rows}
    assert got == want
    # no table grows as filter sets times places
    assert max(df.count() for (name, _), df in sizes.items() if name != "indexed") < 120 * 1_500 / 10 and all(df.count() <= 6 * 3 * 1_500 for (name, _), df in sizes.items() if name == "indexed")


def test_search_looks_at_few_places(spark):
    """Over the 20,000 places of sf0.1, located questions that keep the whole catalog meet one place in twenty or fewer."""
    from placewright.functions.hours import instant_slots, parse_hours, slot_instants, with_open_slots
    from placewright.queries import search as queries

    data = "/root/testdata/sf0.1"
    places = queries.places(spark, data).cache()
    asked = answer.prepared(queries.questions(spark, data)).where("not near and (mode <> 'distance' or located)")
    intervals = parse_hours(places)
    slots = instant_slots(asked.where("open_now"), intervals)
    asked = asked.join(slots, ["day_idx", "sec_of_day"], "left").withColumn("slot", F.when(F.col("open_now"), F.col("slot")))
    slim = with_open_slots(places, intervals, slot_instants(slots)).select("row_id", "p_lat", "p_lng", "categories", "category_name", "price", "reviews", "rating", "hours_raw", "open_slots")
    by_category = search.places_by_category(slim, queries.standard_pairs(spark, data)).drop("categories")
    asks, _ = answer.index_asks(asked)
    _, looked = answer.index_answers(asks, by_category, 30)
    pairs, questions = looked.agg(F.sum("places")).first()[0], asked.count()
    assert questions > 2_000 and pairs < 0.05 * questions * places.count()
    places.unpersist()


def test_lists_of_categories(spark):
    """A place found by any category of the list is one row; what only a further tag finds comes after what the main one finds."""
    places = spark.createDataFrame([(0, "main", -1.45, -48.5, ["Cafe", "Bar"], "Cafe", 1, 10, 3.0, None), (1, "tag", -1.45, -48.5, ["Park", "Bar"], "Park", 1, 10, 5.0, None), (2, "none", -1.45, -48.5, ["Inn"], "Inn", 1, 10, 5.0, None)], PLACE)
    q = spark.createDataFrame([(1, None, None, False, 0, 0, False, ["bar", "cafe", None], None, None, "rating"), (2, None, None, False, 0, 0, False, ["bar"], None, None, "rating"), (3, None, None, False, 0, 0, False, [], None, None, "rating")], QUESTION)
    pairs = spark.createDataFrame(PAIRS, "place_category string, asked string")
    got = sorted((r.question_id, r.position, r.place_id, r.secondary_only) for r in answer.answer_questions(q, places, pairs).collect())
    assert got == [(1, 1, "main", False), (1, 2, "tag", True), (2, 1, "tag", True), (2, 2, "main", True), (3, 1, "tag", False), (3, 2, "none", False), (3, 3, "main", False)]
    # intents decide where no preference does
    some = q.where("question_id = 3").withColumns({"sort_preference": F.lit(None).cast("string"), "intents": F.array(F.lit("popularity"))})
    assert answer.prepared(some).first().mode == "popularity"


def test_phrases_in_random_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aab é") for _ in range(n))
    phrases = sorted({(rng.choice("xyz"), word(rng.randint(1, 6))) for _ in range(80)})
    texts = [(i, word(rng.randint(0, 60)).strip() or None) for i in range(150)] + [(900, None), (901, "ab" * 50_000)]
    lexicon = spark.createDataFrame(phrases, "category string, phrase string")
    messages = spark.createDataFrame(texts, "message_id long, folded string")
    folded = {(c, p) for c, p in [(r.category, r.p) for r in lexicon.select("category", planning.fold(F.col("phrase")).alias("p")).collect()] if p}
    want = sorted((i, c, p) for i, t in texts for c, p in folded if t and p in t)
    assert sorted(map(tuple, planning.scan_lexicon(messages, lexicon).collect())) == want
    assert sorted(map(tuple, planning.scan_lexicon(messages, lexicon, part_phrases=9).collect())) == want
    assert planning.scan_lexicon(messages, lexicon.limit(0)).count() == planning.scan_lexicon(messages.limit(0), lexicon).count() == 0


def test_grounding_is_literal(spark):
    answers = [(1, "", "I like the casa, nova things"), (2, "", "casa - nova"), (3, "", "see casa nova."), (4, "", "see casanova"), (5, "", "the bar (sul) is good"), (6, "", "the bar sul is good"), (7, "casa nova?", "casa nova")]
    a = spark.createDataFrame(answers, "answer_id long, question string, answer string")
    r = a.select("answer_id", F.lit("Bar do Porto").alias("title"))
    titles = spark.createDataFrame([("Casa Nova",), ("Bar (Sul)",), ("Bar do Porto",)], "title string")
    assert {x.answer_id: x.grounded for x in evaluation.grounding(a, r, titles).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True}


def test_unset_slots_and_unlabelled_rows(spark):
    t = spark.createDataFrame([(1, 1, ["a"], True), (1, 2, [], None), (1, 3, None, False), (1, 4, ["b"], None), (1, 5, [], True)], "session_id int, ts int, category array<string>, open_now boolean")
    got = [(r.category, r.open_now) for r in conversations.merge_turns(t, order=("ts",), slots=("open_now",)).orderBy("ts").collect()]
    assert got == [(["a"], True), (["a"], True), (["a"], True), (["b"], None), (["b"], True)]
    rows = spark.createDataFrame([(["b", "a"], "a"), (["a"], ""), ([], "a"), (None, "a"), ([""], "a"), (["a"], None)], "expected array<string>, predicted string")
    assert sorted(map(tuple, evaluation.confusion(rows).collect())) == [("a", "(empty)", 2), ("a", "a", 1)]


def test_map_mismatches(spark):
    catalog = spark.createDataFrame([(0, "p0", "Bar do Porto", -1.45, -48.5), (1, "p1", "Casa Verde", -1.46, -48.5), (2, "p2", "Longe", -1.6, -48.5)], "row_id long, place_id string, title string, lat double, lng double")
    features = spark.createDataFrame([(0, "node", 7, "Bar do Porto", -1.452, -48.5), (1, "way", 8, "Casa Verde", -1.4603, -48.5)], "feature_id long, osm_type string, osm_id long, name string, lat double, lng double")
    out = validation(catalog, features)
    assert [tuple(r) for r in out.mismatches.collect()] == [("p0", "Bar do Porto", "Bar do Porto", "node/7", 222.4)]
    assert {(r.place_id, r.osm_id, r.map_verified) for r in out.catalog.collect()} == {("p0", "node/7", True), ("p1", "way/8", True), ("p2", None, False)}
    assert out.report.first().mismatches == 1 and all(len(k) == 2 for k in matching.TAGS)


# ---- sources


def test_dump_is_cut_by_byte_range(spark, tmp_path):
    rng = random.Random(8)
    odd = ['a } b', '{"x": [', 'quote " and \\ back', "é ü 日本", "}", "{"]
    elements = []
    for i in range(400):
        e = {"type": rng.choice(["node", "way", "relation"]), "id": i, "tags": {"name": rng.choice(odd) * rng.randint(0, 20), "k": rng.choice(odd)}}
        if e["type"] == "node":
            e |= {"lat": i / 7, "lon": -i / 9}
        else:
            e |= {"center": {"lat": 1.5, "lon": 2.5}, "members": [{"type": "node", "ref": j, "role": "}"} for j in range(rng.randint(0, 4))], "nodes": [1, 2]}
        elements.append(e)
    elements.append({"type": "node", "id": 9_999, "lat": 1.0, "lon": 1.0, "tags": {"name": "x" * 30_000}})
    dump = {"version": 0.6, "osm3s": {"copyright": "a } {"}, "elements": elements}
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for indent in (None, 2):
        path = f"{tmp_path}/map{indent}.json"
        with open(path, "w", encoding="utf-8") as f:
            json.dump(dump, f, indent=indent, ensure_ascii=False)
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
            pieces = spark.read.text(path, lineSep="}")
            assert pieces.rdd.getNumPartitions() >= 4
            got = {r.seq: r for r in files.read_map_dump(spark, path).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", default)
        assert sorted(got) == list(range(len(elements)))
        for i, e in enumerate(elements):
            r = got[i]
            assert (r.type, r.id, r.lat, r.lon, r.tags) == (e["type"], e["id"], e.get("lat"), e.get("lon"), e["tags"]) and (r.center is not None) == ("center" in e)


def test_catalog_is_whole_between_any_two_steps(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/catalog"
    row = "row_id long, place_id string, title string, categories array<string>, category_name string, place_type string, address string, neighborhood string, city string, state string, lat double, lng double, phone string, website string, url string, rating double, reviews long, is_sponsored boolean, hours_raw string"
    version = lambda n: spark.createDataFrame([(i, f"v{n}-{i}", *[None] * 17) for i in range(n)], row)
    files.write_catalog(version(3), path)
    ids = lambda: sorted(r.place_id for r in files.read_catalog(spark, path).collect())
    assert ids() == ["v3-0", "v3-1", "v3-2"]
    broken = version(2).withColumn("title", F.raise_error(F.lit("stopped in the middle")))
    with pytest.raises(Exception, match="stopped in the middle"):
        files.write_catalog(broken, path)
    assert ids() == ["v3-0", "v3-1", "v3-2"]
    # written but not renamed: readers still see the version before
    monkeypatch.setattr(files, "versions", lambda s, p, real=files.versions: (_ for _ in ()).throw(RuntimeError("crash")) if len(seen) else (seen.append(1), real(s, p))[1])
    seen = []
    before = files.read_catalog
    with pytest.raises(RuntimeError):
        files.write_catalog(version(5), path)  # crashes while it removes old versions, after the rename
    monkeypatch.undo()
    assert len([r for r in before(spark, path).collect()]) == 5
    for n in (6, 7, 8):
        files.write_catalog(version(n), path)
        assert len(ids()) == n
    assert len(files.versions(spark, path)) == files.KEPT_VERSIONS


# ---- streams


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ordered.STATE_STORE)
    yield
    spark.conf.set(key, before)


def one_file_each(spark, parts, schema, folder):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def run(stream, name, checkpoint):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, stream.sparkSession.table(name)


def test_disordered_hits(spark, tmp_path, state_store):
    """Files out of order within the watermark give what the batch gives; what comes after it is dropped and counted."""
    rng = random.Random(2)
    begin = datetime(2024, 1, 1)
    at = lambda s: begin + timedelta(seconds=s)
    hits = [(v, v * 1000 + i, at(rng.randrange(0, 3000))) for v in range(3) for i in range(40)]
    hits.sort(key=lambda r: r[2].timestamp() + rng.uniform(-250, 250))  # up to 500 seconds out of order
    late = [(1, 5001, at(100)), (7, 5002, at(200))]
    parts = [hits[:40], hits[40:80], hits[80:], [(9, 9001, at(20_000))], late, [(9, 9002, at(40_000))], [(9, 9003, at(60_000))]]
    schema = "visitor long, event_id long, ts timestamp"
    q, table = run(ordered.rate_limit(one_file_each(spark, parts, schema, f"{tmp_path}/in"), 5, 600), "disordered", f"{tmp_path}/cp")
    got = sorted((r.visitor, r.event_id, r.accepted, r.remaining) for r in table.where("visitor < 5").collect())
    want = limits.rate_limit_batch(spark.createDataFrame(hits, schema), 5, 600)
    assert got == sorted((r.visitor, r.event_id, r.accepted, r.remaining) for r in want.collect()) and len({r[2] for r in got}) == 2
    assert ordered.late_rows(q) == len(late)


def test_disordered_chats_and_caps(spark, tmp_path, state_store):
    rng = random.Random(3)
    begin = datetime(2024, 1, 1)
    rows = [(v, v * 1000 + i, begin + timedelta(seconds=rng.randrange(0, 6000)), rng.choice([None, "more"]), f"p{i}", list(range(rng.randrange(0, 14)))) for v in range(3) for i in range(25)]
    rows.sort(key=lambda r: r[2].timestamp() + rng.uniform(-250, 250))
    schema = "visitor long, event_id long, ts timestamp, action string, plan string, ranked array<long>"
    end = [[(9, 9000 + i, begin + timedelta(days=3 * (i + 1)), None, "x", [])] for i in range(2)]
    _, table = run(ordered.chat(one_file_each(spark, [rows[:30], rows[30:50], rows[50:], *end], schema, f"{tmp_path}/in"), 4, 600, 2, 1800), "chats_out_of_order", f"{tmp_path}/cp")
    want = limits.chat_batch(spark.createDataFrame(rows, schema), 4, 600, 2, 1800)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.where("visitor < 5").collect())))
    assert key(table) == key(want) and {r.status for r in want.collect()} >= {"answered", "page", "denied", "finished"}
    calls = [(r[1], r[2]) for r in rows]
    stream = one_file_each(spark, [calls[:30], calls[30:50], calls[50:], [(9000, begin + timedelta(days=3))], [(9001, begin + timedelta(days=6))]], "event_id long, ts timestamp", f"{tmp_path}/calls")
    _, table = run(ordered.daily_cap(stream, 20, "America/Sao_Paulo"), "caps_out_of_order", f"{tmp_path}/cp2")
    want = conversations.daily_cap(spark.createDataFrame(calls, "event_id long, ts timestamp"), 20, "America/Sao_Paulo").select("event_id", F.col("local_day").cast("string"), "allowed")
    assert sorted(map(tuple, table.where("event_id < 9000").collect())) == sorted(map(tuple, want.collect()))
