"""Operators of the place engine on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from placewright.functions import geo, hours, text
from placewright.operators import catalog, conversations, evaluation, matching, planning, search
from placewright.plans.answer import answer_questions, unanswerable
from placewright.plans.catalog import build_catalog
from placewright.plans.validate import validate_catalog
from placewright.sources import files
from placewright.streaming import limits


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_text_columns(spark):
    df = spark.createDataFrame([("   ", "x.5", " 4.9 ", "sim", "Ação_Ã "), (None, "nan", "", None, None)], "a string, b string, c string, d string, e string")
    got = df.select(text.clean_str(F.col("a")), text.clean_num(F.col("b")), text.clean_int(F.col("c")), text.clean_bool(F.col("d")), text.fold(F.col("e"), underscores=True)).collect()
    assert list(got[0]) == [None, None, 4, True, "acao a"] and list(got[1])[2:] == [0, False, None]
    titles = [("casa da mãe", "Casa da Mãe"), ("BAR DO ZÉ", "Bar do Zé"), ("KFC", "KFC"), ("Da Vinci", "Da Vinci"), ("a casa", "A Casa")]
    df = spark.createDataFrame(titles, "t string, want string")
    assert all(r.x == r.want for r in df.select("want", text.recase_title(F.col("t"), catalog.SMALL_WORDS).alias("x")).collect())
    assert text.indel_ratio("abcd", "abxd") == 0.75 and text.partial_ratio("bar", "o bar do ze") == 1.0 and text.name_score("bar", "bar") == 1.0
    chain = lambda c, hops: one(spark, text.visitor_ip(F.lit(c), F.lit("peer"), hops))
    assert chain("1.1.1.1, 2.2.2.2", 1) == "2.2.2.2" and chain("1.1.1.1, 2.2.2.2", 2) == "1.1.1.1" and chain("a, b", 1) == "peer" and chain(None, 1) == "peer" and chain("1.1.1.300", 1) == "peer"


def test_near_join_equals_brute_force(spark):
    q = spark.range(60).select(F.col("id").alias("question_id"), (-1.4 - (F.col("id") * 37 % 101) / 2000).alias("lat"), (-48.5 + (F.col("id") * 53 % 97) / 1500).alias("lng"))
    p = spark.range(200).select(F.col("id").alias("row_id"), F.when(F.col("id") % 9 > 0, -1.4 - (F.col("id") * 71 % 211) / 4000).alias("p_lat"), (-48.5 + (F.col("id") * 29 % 199) / 3000).alias("p_lng"))
    want = q.crossJoin(p).withColumn("km", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))).where("km <= 1.3")
    key = lambda df: {(r.question_id, r.row_id) for r in df.collect()}
    assert key(geo.near_join(q, p, 1.3)) == key(want) != set()


def test_near_join_anywhere(spark):
    spots = [(lat + dy, lng + dx) for lat, lng in ((0, 0), (69.6, 18.9), (-77.8, 179.995), (89.99, 10), (51.5, -179.999), (-90, 0)) for dy in (0, 0.004, -0.006) for dx in (0, 0.004, -0.03, 5)]
    rows = [(i, max(-90.0, min(90.0, float(lat))), (lng + 180.0) % 360 - 180) for i, (lat, lng) in enumerate(spots)]
    q = spark.createDataFrame(rows, "question_id long, lat double, lng double")
    p = q.select(F.col("question_id").alias("row_id"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    want = q.crossJoin(p).where(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")) <= 1.0).select("question_id", "row_id")
    got = geo.near_join(q, p, 1.0).select("question_id", "row_id")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > len(rows)


HOURS = [
    ("Monday-Sunday: 3 to 9 PM", {d: [(54000, 75600)] for d in range(7)}), ("Friday-Monday: 9 PM to 2 AM", {d: [(75600, 7200)] for d in (4, 5, 6, 0)}),
    ("Mon,Wed: 8 AM to 11:30 AM, 1 to 5 PM; Tue: closed", {0: [(28800, 41400), (46800, 61200)], 2: [(28800, 41400), (46800, 61200)]}), ("Atendimento 24 horas", {d: [(0, 86340)] for d in range(7)}),
    ("Domingo: 12 AM to 12 PM", {6: [(0, 43200)]}), ('{"Mon": "09:00-18:00", "Tue": "closed"}', {0: [(32400, 64800)]}), ("Monday: 9 AM to 5 PM; Monday: 10 AM to 6 PM", {0: [(36000, 64800)]}),
    ("Segunda-feira: 9 AM to 5 PM", {}), ("no idea", {}), ("Mon 09:00-18:00", {0: [(0, 64800)]}), ("Saturday: 11 to 2 PM", {5: [(82800, 50400)]}),
]


def test_hours(spark):
    df = spark.createDataFrame([(t,) for t, _ in HOURS], "hours_raw string")
    got = {t: {} for t, _ in HOURS}
    for r in hours.parse_hours(df).orderBy("start_s").collect():
        got[r.hours_raw].setdefault(r.day, []).append((r.start_s, r.end_s))
    for t, want in HOURS:
        if t != "Mon 09:00-18:00":  # the day part is cut at the first colon, and "Mon 09" is still a Monday
            assert {d: sorted(v) for d, v in got[t].items()} == {d: sorted(v) for d, v in want.items()}, t
    q = spark.createDataFrame([(1, 5, 3600), (2, 5, 7200), (3, 4, 76000), (4, 1, 3600), (5, 0, 86340), (6, 0, 86370)], "question_id long, day_idx int, sec_of_day long")
    every = hours.with_week(df, hours.parse_hours(df)).crossJoin(q)
    found = {(r.question_id, r.hours_raw) for r in every.where(hours.is_open(F.col("week"), F.col("day_idx"), F.col("sec_of_day"))).collect()}
    night = "Friday-Monday: 9 PM to 2 AM"
    assert {i for i, t in found if t == night} == {1, 3, 4, 5, 6}
    assert {i for i, t in found if t == "Atendimento 24 horas"} == {1, 2, 3, 4, 5}
    slots = hours.instant_slots(q, hours.parse_hours(df))
    held = hours.with_open_slots(df, hours.parse_hours(df), hours.slot_instants(slots)).crossJoin(q.join(slots, ["day_idx", "sec_of_day"]))
    assert {(r.question_id, r.hours_raw) for r in held.where(hours.open_in(F.col("open_slots"), F.col("slot"))).collect()} == found


def candidates(spark):
    rows = [(1, i, f"P{i}", ["bar" if i > 4 else "cafe"], "bar" if i > 4 else "cafe", 0.1 * i, 4.0 + i % 2, 10 * i, i % 5 or None, None) for i in range(1, 9)]
    return spark.createDataFrame(rows, "question_id long, row_id long, place_id string, categories array<string>, category_name string, km double, rating double, reviews long, price long, hours_raw string")


def test_filters_and_ranks(spark):
    c = candidates(spark).withColumns({"price_max": F.lit(2), "min_rating": F.lit(4.5), "category": F.lit("asked")})
    used = search.escalate_radius(c)
    assert {r.radius_used for r in used.collect()} == {0.5} and used.count() == 5  # four cafés and a bar settle the radius before the category does
    pairs = spark.createDataFrame([("bar", "asked")], "place_category string, asked string")
    assert [r.row_id for r in search.filter_category(used, pairs).collect()] == [5]
    assert sorted(r.row_id for r in search.filter_price(c).collect()) == [1, 2, 5, 6, 7]
    assert sorted(r.row_id for r in search.filter_rating(c).collect()) == [1, 3, 5, 7]
    order = lambda m: [r.row_id for r in search.rank(search.score_columns(c).withColumn("mode", F.lit(m))).orderBy("position").collect()]
    assert order("distance") == list(range(1, 9)) and order("rating") == [7, 5, 3, 1, 8, 6, 4, 2] and order("popularity")[0] == 7
    ranked = search.rank(search.score_columns(c).withColumn("mode", F.lit("distance")))
    assert [(r.position, r.has_more) for r in search.page(ranked, 1).orderBy("position").collect()][-1] == (5, True)
    assert [(r.position, r.has_more) for r in search.page(ranked, 2).orderBy("position").collect()][-1] == (8, False) and search.page(ranked, 3).count() == 0


def test_answers_of_small_catalog(spark):
    """What a question gets by hand: radius only when it is located and asks for nearness, else the whole catalog."""
    places = spark.createDataFrame(
        [(0, "near", -1.45, -48.5, ["Bar"], "Bar", 1, 10, 4.0, "Monday-Sunday: 5 PM to 1 AM"), (1, "mid", -1.455, -48.5, ["Cafe", "Bar"], "Cafe", 3, 100, 4.8, None),
         (2, "far", -1.49, -48.5, ["Bar"], "Bar", None, 50, 4.5, "Monday: Closed"), (3, "lost", None, None, ["Bar"], "Bar", 2, 5, None, "Monday-Sunday: 24 hours"), (4, "bare", -1.47, -48.5, [], "Bar", 2, 1, 3.0, "")],
        "row_id long, place_id string, p_lat double, p_lng double, categories array<string>, category_name string, price long, reviews long, rating double, hours_raw string",
    )
    here, kinds = (-1.45, -48.5), "question_id long, lat double, lng double, near_me boolean, day_idx int, sec_of_day long, open_now boolean, category string, price_range string, min_rating double, sort_preference string"
    asks = [
        (1, *here, True, 0, 0, False, None, None, None, "distance"), (2, *here, False, 0, 0, False, None, None, None, "distance"), (3, None, None, True, 0, 0, False, "bar", None, None, "rating"),
        (4, *here, False, 0, 72000, True, None, None, None, "popularity"), (5, None, None, True, 0, 0, False, None, None, None, "distance"), (6, *here, True, 0, 0, False, "tea", None, None, "rating"),
        (7, None, None, None, 0, 0, None, None, "$$", None, "best_match"), (8, *here, None, 0, 0, None, "bar", None, 4.2, "best_match"), (9, 40.0, 10.0, True, 0, 0, False, None, None, None, "rating"),
    ]
    pairs = spark.createDataFrame([("Bar", "bar"), ("Pub", "bar")], "place_category string, asked string")
    q = spark.createDataFrame(asks, kinds)
    got = {}
    for r in answer_questions(q, places, pairs).orderBy("question_id", "position").collect():
        got.setdefault(r.question_id, []).append(r)
    names = {i: [r.place_id for r in rs] for i, rs in got.items()}
    assert names[1] == ["near", "mid"] and got[1][0].radius_used == 2.0  # fewer than five within 2 km
    assert names[2] == ["near", "mid", "bare", "far", "lost"] and got[2][4].km is None
    assert names[3] == ["far", "near", "bare", "lost", "mid"] and got[3][4].secondary_only and got[3][0].km is None
    assert names[4] == ["lost", "near", "mid", "bare"] or names[4] == ["near", "lost", "mid", "bare"]
    assert {r.place_id: r.open_status for r in got[4]} == {"near": "open", "lost": "open", "mid": "unknown", "bare": "unknown"} and got[4][0].n_candidates == 4 and got[4][0].radius_used is None
    assert 5 not in names and [(r.question_id, r.error[:10]) for r in unanswerable(q).collect()] == [(5, "a location")]
    assert 6 not in names and 9 not in names  # a place without categories passes, but none is near
    assert set(names[7]) == {"near", "far", "lost", "bare"} and names[8] == ["far", "mid"]
    assert answer_questions(q.limit(0), places, pairs).count() == 0 and answer_questions(q, places.limit(0), pairs).count() == 0


def test_catalog_build(spark, tmp_path):
    head = "placeId,title,categoryName,categories/0,categories/1,address,formattedAddress,neighborhood,city,state,location/lat,location/lng,phone,website,url,totalScore,reviewsCount,price,IsSponsored,isSponsored,businessTime"
    rows = [
        'a,Bar do Porto,Bar,Bar,,"Rua 1, 2",,,São Luís,MA,-1.45,-48.5,,,,4.1,120,,No,,Monday-Sunday: 5 PM to 1 AM', "a,Bar do Porto,Bar,Bar,Pub,,,,São Luís,MA,-1.45,-48.5,,,,4.3,1284,,No,,",
        "b,S?o Brás,Cafe,,,,Av 3,,S?o Lu?s,MA,-1.45,-48.5,,,,0,0,,SIM,,", "c,BOM DIA DE SOL,Barber shop,,,,,,Elsewhere,MA,-1.45,-48.5,,,,5,3,,,,", ",none,,,,,,,São Luís,MA,,,,,,,,,,,",
        'd,parque da cidade,Park,,,,,,sao luis,X,,,,,,4.0,9,,,sim,"0    08:00\nName: openingHours, dtype: object"',
    ]
    (tmp_path / "e.csv").write_text("\n".join([head, *rows]), encoding="utf-8")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "r.csv").write_text("placeId,title,city\nb,S?o,x\nb,São Brás,x\nb,Other,x\n", encoding="utf-8")
    (tmp_path / "raw" / "skip.csv").write_text("id,name\n1,2\n", encoding="utf-8")
    city = catalog.City("São Luís", "MA", ("São Luís",), (-2, -1, -49, -48))
    export = files.read_export(spark, f"{tmp_path}/e.csv")
    assert [r.row_id for r in export.orderBy("row_id").collect()] == list(range(6))
    built, report = build_catalog(export, files.read_repairs(spark, f"{tmp_path}/raw"), city)
    got = {r.place_id: r for r in built.collect()}
    assert set(got) == {"a", "b", "d"} and got["a"].categories == ["Bar", "Pub"] and got["a"].reviews == 1284 and got["a"].row_id == 0
    assert got["b"].title == "São Brás" and got["b"].rating is None and got["b"].is_sponsored and got["b"].address == "Av 3" and got["b"].place_type == "restaurant"
    assert got["d"].title == "Parque da Cidade" and got["d"].hours_status == "garbage" and got["d"].place_type == "park" and got["d"].state == "MA"
    r = report.first()
    assert (r.input_rows, r.kept, r.merged_duplicates, r.dropped, r.titles_repaired_from_raw, r.hours_unknown, r.hours_garbage_cleared) == (6, 3, 1, 2, 1, 3, 1)
    files.write_catalog(built, f"{tmp_path}/out")
    files.write_catalog(built.where("place_id = 'a'"), f"{tmp_path}/out")
    assert [x.place_id for x in files.read_catalog(spark, f"{tmp_path}/out").collect()] == ["a"]
    files.write_report(report, f"{tmp_path}/report")
    assert catalog.title_search(built, spark.createDataFrame([("sao bras",), ("parque sol",)], "query string")).collect()[0].place_id == "b"


def test_map_validation(spark, tmp_path):
    places = spark.createDataFrame([(0, "p0", "Bar do Porto", -1.45, -48.5), (1, "p1", "Casa Verde", -1.46, -48.5), (2, "p2", "Longe", -1.6, -48.5)], "row_id long, place_id string, title string, lat double, lng double")
    dump = '{"elements": [{"type": "node", "id": 1, "lat": -1.45036, "lon": -48.5, "tags": {"name": "Bar do Pôrto", "amenity": "pub", "tourism": "hotel", "addr:street": "Rua A", "addr:housenumber": "7"}},' \
        '{"type": "way", "id": 2, "center": {"lat": -1.46, "lon": -48.5001}, "tags": {"name": "Casa Verde", "contact:phone": "9"}}, {"type": "node", "id": 1, "lat": 1, "lon": 1, "tags": {"name": "again"}},' \
        '{"type": "node", "id": 3, "tags": {"name": "nowhere"}}, {"type": "node", "id": 4, "lat": -1.46, "lon": -48.5, "tags": {"name": "Casa Verde"}}, {"type": "node", "id": 5, "lat": 2, "lon": 2, "tags": {}}]}'
    (tmp_path / "map.json").write_text(dump, encoding="utf-8")
    f = matching.parse_features(files.read_map_dump(spark, f"{tmp_path}/map.json"))
    rows = {(r.osm_type, r.osm_id): r for r in f.collect()}
    assert set(rows) == {("node", 1), ("way", 2), ("node", 4)} and rows["node", 1].category == "bar" and rows["node", 1].subcategories == ["hotel"] and rows["node", 1].address == "Rua A, 7" and rows["way", 2].phone == "9"
    features = f.withColumn("feature_id", F.col("seq"))
    got = {(r.status, r.feature_id, r.place_id) for r in matching.match_all(features, places.withColumnRenamed("lat", "p_lat").withColumnRenamed("lng", "p_lng"), 50.0).collect()}
    assert got == {("matched", 0, "p0"), ("matched", 1, "p1"), ("new", 4, None), ("possibly_closed", None, "p2")}
    flagged, report = validate_catalog(places, features)
    assert {r.place_id for r in flagged.where("map_verified").collect()} == {"p0", "p1"} and report.first().match_rate == 0.667
    with pytest.raises(ValueError):
        validate_catalog(places, features.limit(0))


def test_planning(spark):
    messages = [
        ("restaurante aberto agora", True, "pt-BR"), ("aberto domingo", None, "pt-BR"), ("open bar", None, "en"), ("is it open now or closed now", None, "en"), ("farmacia 24h", True, "pt-BR"), ("open at 9 h", None, "en"),
    ]
    df = spark.createDataFrame(messages, "text string, want boolean, lang string").withColumn("message_id", F.monotonically_increasing_id())
    assert all(r.open_now == r.want and r.language == r.lang for r in planning.plan_messages(df).collect())
    gate = spark.createDataFrame([("ok  go",), ("a" * 401,), ("x" * 1601,), ("a@b",), ("   ",), ("café",), (None,)], "text string")
    assert [(r.reason, r.clean) for r in planning.gate_messages(gate).collect()] == [(None, "ok go"), ("too_long", None), ("too_long", None), ("bad_chars", None), ("empty", None), (None, "café"), ("empty", None)]
    f = lambda s: F.lit(s)
    assert one(spark, planning.extract_price_max(f("cheap, $ 30"))) == 30 and one(spark, planning.extract_price_max(f("muito caro"))) == 4 and one(spark, planning.extract_min_rating(f("nota acima de 4.5"))) == 4.5
    words = spark.createDataFrame([("k", "bar", "bar"), ("k", "vet", "vet")], "kind string, label string, keyword string")
    hits = planning.scan_keywords(spark.createDataFrame([(1, "bares e sorvete")], "message_id long, folded string"), words).collect()
    assert [(r.label, r.keyword) for r in hits] == [("bar", "bar")]


def test_category_pairs(spark):
    p = spark.createDataFrame([("Açaí shop",), ("Motel",), ("Sorveteria",), ("Hospitals",)], "place_category string")
    a = spark.createDataFrame([("acai",), ("hotel",), ("ice_cream",), ("hospital",)], "asked string")
    k = spark.createDataFrame([("c", "ice cream", "sorveteria")], "kind string, label string, keyword string")
    got = {(r.place_category, r.asked) for r in matching.category_pairs(p, a, k).collect()}
    assert got == {("Açaí shop", "acai"), ("Motel", "hotel"), ("Sorveteria", "ice_cream"), ("Hospitals", "hospital")}


def test_turns(spark):
    t = spark.createDataFrame([(1, 1, "bar", True, 4.0), (1, 2, None, None, None), (1, 3, None, None, 3.0), (1, 4, "cafe", None, None), (1, 5, None, False, None)], "session_id int, ts int, category string, open_now boolean, min_rating double")
    got = [(r.category, r.open_now, r.min_rating) for r in conversations.merge_turns(t, order=("ts",)).orderBy("ts").collect()]
    assert got == [("bar", True, 4.0), ("bar", True, 4.0), ("bar", True, 3.0), ("cafe", None, None), ("cafe", None, None)]
    e = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:30:00"), (1, 3, "2024-01-01 01:00:01")], "visitor long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.session_no for r in conversations.sessionize(e).orderBy("event_id").collect()] == [0, 0, 1]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [(v, i * 10 + v, 1_700_000_000 + i * (40 + v)) for i in range(40) for v in range(3)]
    e = spark.createDataFrame(rows, "visitor long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    got = limits.run_available(limits.rate_limit(stream, 5, 600), "hits", f"{tmp_path}/cp")
    want = limits.rate_limit_batch(e, 5, 600)
    key = lambda df: sorted((r.visitor, r.event_id, r.accepted, r.remaining) for r in df.collect())
    assert key(got) == key(want) and 0 < want.where("accepted").count() < 120
    assert limits.take_hits([], [(0, 1), (600_000_000, 2)], 1, 600)[1] == [(1, 0, True, 0), (2, 600_000_000, True, 0)]


def test_conversation_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, i, 1000 + i * 60 + (4000 if i > 5 else 0)) for i in range(8)], "visitor long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in").withColumn("ts_us", F.unix_micros("ts")).withWatermark("ts", "10 minutes")
    got = limits.run_available(limits.conversations(stream), "turns", f"{tmp_path}/cp")
    starts = [r.session_start for r in got.orderBy("event_id").collect()]
    assert [(r.turn, r.allowed) for r in got.orderBy("event_id").collect()] == [(k, k <= 4) for k in range(1, 7)] + [(1, True), (2, True)]
    assert len(set(starts[:6])) == len(set(starts[6:])) == 1 and starts[0] < starts[6]


def test_chat_stream_equals_batch(spark, tmp_path):
    ids = list(range(12))
    rows = [(1, 1, 0, None, "a", ids), (1, 2, 10, "more", None, None), (1, 3, 20, "more", None, None), (1, 4, 30, "more", None, None), (1, 5, 40, None, "b", [7]), (1, 6, 50, None, "c", []), (1, 7, 60, "more", None, None),
            (1, 8, 70, None, "d", ids), (1, 9, 4000, "more", None, None), (1, 10, 4001, None, "e", ids), (2, 11, 0, "more", None, None)] + [(3, 20 + i, i, None, "x", ids) for i in range(4)]
    e = spark.createDataFrame(rows, "visitor long, event_id long, s long, action string, plan string, ranked array<long>").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = limits.chat_stream(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), 10, 600, 3, 1800)
    got = {r.event_id: r for r in limits.run_available(stream, "chat", f"{tmp_path}/cp").collect()}
    assert got == {r.event_id: r for r in limits.chat_batch(e, 10, 600, 3, 1800).collect()}
    assert [(got[i].status, got[i].page, got[i].has_more) for i in (1, 2, 3, 4)] == [("answered", ids[:5], True), ("page", ids[5:10], True), ("page", ids[10:], False), ("page", [], False)]
    assert [(got[i].status, got[i].turn, got[i].plan) for i in (5, 6, 7, 8, 9, 10, 11)] == [
        ("answered", 2, "b"), ("answered", 3, "c"), ("no_results", 3, None), ("finished", 3, None), ("no_results", 0, None), ("answered", 1, "e"), ("no_results", 0, None)]
    assert [got[20 + i].status for i in range(4)] == ["answered"] * 3 + ["finished"]
    few = {r.event_id: r.status for r in limits.chat_batch(e, 1, 600, 3, 1800).collect()}
    assert few[2] == "denied" and few[9] == "no_results" and few[10] == "denied"


def test_daily_cap_stream_equals_batch(spark, tmp_path):
    e = spark.range(60).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 5000).alias("ts"))
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = limits.run_available(limits.daily_cap_stream(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), 4, "America/Sao_Paulo"), "caps", f"{tmp_path}/cp")
    want = conversations.daily_cap(e, 4, "America/Sao_Paulo").select("event_id", F.col("local_day").cast("string"), "allowed")
    assert sorted(got.collect()) == sorted(want.collect()) and want.where("allowed").count() == 20  # four on each of five local days


def test_grounding(spark):
    answers = [(1, "", "Go to **Bar do Porto**."), (2, "", "Go to **Bar do Portu**."), (3, "", "Go to **Casa Nova**."), (4, "perto do Teatro da Paz", "Near Teatro da Paz: **Bar do Porto**"), (5, "", "Near the Teatro da Paz"), (6, "", "Botequim is nice")]
    a = spark.createDataFrame(answers, "answer_id long, question string, answer string")
    r = a.select("answer_id", F.lit("Bar do Porto").alias("title"))
    t = spark.createDataFrame([("Teatro da Paz",), ("Botequim",), ("Bar do Porto",)], "title string")
    assert {x.answer_id: x.grounded for x in evaluation.grounding(a, r, t).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_text_model_reads_whole_texts(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array

    from placewright.operators import text_model
    from placewright.queries import matching as queries

    opening = "lorem ipsum dolor " * 20  # over 300 letters, the same in every document
    ends = {"en": "the house and the water were with them", "fr": "la maison et les eaux étaient avec_elles\t où?"}
    rows = [(i, opening + " ".join([ends[lang]] * (i % 3 + 1)) + f" x{i}", lang) for i, lang in enumerate(list(ends) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.primary for r in queries.text_model(spark, str(tmp_path)).collect()} == {i: lang for i, _, lang in rows}
    # the scores are those of the fitted stages
    model = text_model.train_text_model(docs.select("text", F.col("lang").alias("label")), 30, 60, 20)
    more = spark.createDataFrame([*[(i, t) for i, t, _ in rows[:6]], (100, ""), (101, "a"), (102, "LES eaux, les  maison\n"), (103, "the où the house")], "doc_id long, text string")
    out = text_model.with_grams(more.withColumn("label", F.lit("en")))
    for stage in model.stages[1:]:
        out = stage.transform(out)
    want = {r.doc_id: max(r.p) for r in out.select("doc_id", vector_to_array("probability").alias("p")).collect()}
    got = {r.doc_id: r.confidence for r in text_model.score_text(more, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_character_grams_of_a_text_are_found_at_once(spark):
    import re
    import sys
    from collections import Counter

    from placewright.operators import text_model

    ends = {"en": "the house and the water were with them", "fr": "la maison et les eaux étaient avec_elles\t où?"}
    docs = spark.createDataFrame([(f"{t} x{i}", lang) for i in range(8) for lang, t in ends.items()], "text string, label string")
    model = text_model.train_text_model(docs, 30, 60, 5)
    scorer, vocabulary = text_model.GramScorer(model), model.stages[4].vocabulary
    scorer.PIECE = 7  # pieces that cut words
    for text in ("", " ", "a", "\t\nthe  water\x0bwere \r", "maison où? \U0001f600 the \ud800 et", "the\u00a0house", *ends.values()):
        spaced = [f" {w} " for w in re.split(r"[ \t\n\x0b\f\r]+", text)]
        seen = Counter(w[i : i + n] for w in spaced for n in (3, 4, 5) for i in range(len(w) - n + 1))
        assert scorer.inside(text).tolist() == [seen[g] for g in vocabulary]
    # words that were never seen are no work of their own
    scorer, calls = text_model.GramScorer(model), []
    text = " ".join(f"w{i}" for i in range(5_000))
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    scorer.probabilities(text)
    sys.setprofile(None)
    assert len(calls) < 1_000


def test_category_pairs_loses_no_close_pair(spark, tmp_path):
    import itertools
    import random
    from difflib import SequenceMatcher

    from placewright.queries import matching as queries

    rng = random.Random(3)
    names = {"abcdef", "abxcdyef", "lounge", "lo un ge", "motel", "morel", "sushi", "suxhi", "ab", "abc", "bar", "bars", "a"} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)}
    near = {(x, y) for x, y in itertools.product(names, names) if x == y or SequenceMatcher(None, x, y).ratio() >= 0.8}
    df = spark.createDataFrame([(x, x) for x in names], "place_category string, asked string")
    got = {(r.place_category, r.asked) for r in matching.category_pairs(df, df).collect()}
    assert got - {("motel", "hotel")} == near and {("lounge", "lo un ge"), ("motel", "morel"), ("abcdef", "abxcdyef")} <= got
    # every name is asked, whatever its key
    spark.createDataFrame([(i, f"thing{i}") for i in range(8)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.asked for r in queries.vocabulary_fuzzy(spark, str(tmp_path)).collect()} == {f"thing{i}" for i in range(8)}


def test_long_titles_and_keywords(spark):
    long_ = "Casa de Sucos e Lanches da Dona Maria do Porto"
    a = spark.createDataFrame([(1, "", f"Try {long_} now"), (2, "", "Try Casa de Sucos e Lanches da Dona Maria")], "answer_id long, question string, answer string")
    r = spark.createDataFrame([(1, "Bar do Porto"), (2, "Bar do Porto")], "answer_id long, title string")
    assert {x.answer_id: x.grounded for x in evaluation.grounding(a, r, spark.createDataFrame([(long_,)], "title string")).collect()} == {1: False, 2: True}
    words = spark.createDataFrame([("c", "all you can eat buffet"), ("d", "bar")], "label string, keyword string")
    hits = planning.scan_keywords(spark.createDataFrame([(1, "two all you can eat buffets or bars"), (2, "you can eat")], "message_id long, folded string"), words).collect()
    assert {(h.message_id, h.label) for h in hits} == {(1, "c"), (1, "d")}
