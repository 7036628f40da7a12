"""Questions in, ranked places out.

Filters come in a fixed order: open places, then the radius, then category, price and rating; what is left is ranked. The
radius holds only for located questions that ask for nearness. All others keep the whole catalog, and the distance is for
ranking and display.

Work is split by what decides the order, so that questions meet no more places than they must:

* near: each cell of questions meets the places in its reach, location by location (see discs).
* others: questions that agree in filters, ranking and, where it counts, location are one. Each visits the cells of an index of the
  places, best bound first, until no other cell can hold one of its first k (see place_index). Best match needs the farthest
  place that the filters leave, which is searched for the same way.
* How many places the filters leave no location changes: places are counted by what filters look at, once for each
  different limit of price and rating, and then by the texts that are open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.geo import haversine_km
from placewright.functions.hours import instant_slots, parse_hours, slot_instants, with_open_slots
from placewright.operators import discs, place_index, search
from placewright.tables import written

OPTIONAL = {"near_me": "boolean", "price_max": "double", "price_range": "string", "min_rating": "double", "open_now": "boolean", "category": "string", "intents": "array<string>"}
#: Tasks among which the rows of one key are dealt where they are counted.
DEALS = 16
FILTERS = ("open_now", "slot", "category", "price_max", "min_rating")


def prepared(questions: DataFrame) -> DataFrame:
    """The questions with every slot, their ranking mode, located, and near: located and asking for nearness."""
    given = set(questions.columns)
    q = questions.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in given})
    q = q.withColumns({
        "price_max": search.most_price(F.col("price_range"), F.col("price_max")), "open_now": F.coalesce("open_now", F.lit(False)), "mode": search.ranking_mode(F.col("sort_preference"), F.col("intents")),
        "located": F.col("lat").isNotNull() & F.col("lng").isNotNull(),
    })
    q = q.withColumn("near", F.col("located") & F.coalesce("near_me", F.lit(False)))
    return q.select("question_id", "lat", "lng", "located", "near", "day_idx", "sec_of_day", "open_now", "category", "price_max", "min_rating", "mode")


def unanswerable(questions: DataFrame) -> DataFrame:
    """(question_id, error) of questions that are ranked by distance without having a location; answer_questions gives them no rows."""
    return prepared(questions).where("mode = 'distance' and not located").select("question_id", F.lit("a location is required for distance ranking").alias("error"))


def near_answers(questions: DataFrame, sorted_places: DataFrame, k: int) -> DataFrame:
    found = discs.best_in_radius(questions, sorted_places, k).withColumn("km", _distance())
    return search.rank(search.score_columns(found, None), k).select("question_id", "row_id", "position", "open_status", "secondary_only", "n_candidates", "radius_used")


def key_of(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def counted(sets: DataFrame, sorted_places: DataFrame) -> DataFrame:
    """(set, n_candidates): how many places each set of filters leaves."""
    lists = sorted_places.groupBy("asked", "hours_raw", "price", "rating").agg(F.count(F.lit(1)).alias("n"), F.first("open_slots", True).alias("open_slots"))
    lists = lists.withColumn("list", F.xxhash64("hours_raw", "price", "rating"))
    sets = sets.withColumn("limits", key_of("category", "price_max", "min_rating"))
    limits = search.by_category(sets.select("limits", "category", "price_max", "min_rating").distinct())
    left = search.filter_rating(search.filter_price(place_index.dealt_join(limits, lists, ["asked"], "list", DEALS)))
    texts = left.groupBy("limits", "hours_raw").agg(F.sum("n").alias("n"), F.first("open_slots", True).alias("open_slots"))
    met = place_index.dealt_join(sets.select("set", "limits", "open_now", "slot"), texts, ["limits"], "hours_raw", DEALS)
    return search.filter_open_at(met).groupBy("set").agg(F.sum("n").alias("n_candidates"))


def index_asks(questions: DataFrame, own: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What has to be searched for, each different one once, and the questions with its key: filters, ranking, and the location where that decides the order (or `own` says so)."""
    own = F.col("located") & F.col("mode").isin("distance", "best_match") if own is None else own
    keyed = questions.withColumns({c: F.when(own, F.col(c)) for c in ("lat", "lng")})
    keyed = keyed.withColumns({"set": key_of(*FILTERS), "key": key_of("mode", "lat", "lng", *FILTERS)})
    asks = keyed.select("key", "set", "mode", "lat", "lng", *FILTERS).distinct()
    asks = asks.withColumns({"ask": F.monotonically_increasing_id(), "kind": place_index.kind_of(F.col("mode"), F.col("lat").isNotNull()), "farthest": F.lit(None).cast("double")})
    return written(asks, "asks"), keyed.select("question_id", "key", "set")


def index_answers(asks: DataFrame, sorted_places: DataFrame, k: int, cell_places: int = place_index.CELL_PLACES) -> tuple[DataFrame, DataFrame]:
    """The first k places of each ask; how many places each looked at, a row for each round."""
    served = asks.select("kind", F.col("category").isNull().alias("any")).distinct().collect()
    with_far = lambda kinds: sorted({*kinds, "spatial"} if "best" in kinds else kinds)
    kinds, of_any = with_far({r.kind for r in served}), with_far({r.kind for r in served if r.any})
    rows, cells, groups = place_index.indexed(sorted_places, kinds or ["quality"], cell_places, of_any)
    if "best" not in kinds:
        return place_index.best_places(asks, rows, cells, groups, k)
    far = asks.where("kind = 'best'").withColumns({"mode": F.lit("farthest"), "kind": F.lit("spatial")})
    farthest, looked = place_index.best_places(far, rows, cells, groups, 1)
    asks = asks.drop("farthest").join(farthest.select("ask", F.col("km").alias("farthest")).hint("merge"), "ask", "left")
    found, more = place_index.best_places(asks, rows, cells, groups, k)
    return found, looked.unionByName(more)


def other_answers(questions: DataFrame, sorted_places: DataFrame, k: int) -> DataFrame:
    """Questions that keep the whole catalog."""
    asks, keyed = index_asks(questions)
    found, _ = index_answers(asks, sorted_places, k)
    counts = counted(asks.select("set", *FILTERS).distinct(), sorted_places)
    top = found.join(asks.select("ask", "key").hint("merge"), "ask").select("key", "row_id", "position", "open_status", "secondary_only")
    return keyed.join(top.hint("merge"), "key").join(counts.hint("merge"), "set").drop("key", "set")


def _tables(questions: DataFrame, places: DataFrame, category_pairs: DataFrame, intervals: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The questions as prepared with their slots, and the places by what is asked of them, both written."""
    intervals = written(parse_hours(places) if intervals is None else intervals, "intervals")
    asked = prepared(questions).where("mode <> 'distance' or located")
    slots = written(instant_slots(asked.where("open_now"), intervals), "slots")
    asked = written(asked.join(slots.hint("merge"), ["day_idx", "sec_of_day"], "left").withColumn("slot", F.when(F.col("open_now"), F.col("slot"))), "questions")
    slim = places.select("row_id", "p_lat", "p_lng", "categories", "category_name", "price", "reviews", "rating", "hours_raw")
    slim = written(with_open_slots(slim, intervals, slot_instants(slots)), "places")
    return asked, written(search.places_by_category(slim, category_pairs).drop("categories"), "places")


def answer_questions(questions: DataFrame, places: DataFrame, category_pairs: DataFrame, intervals: DataFrame | None = None, k: int = search.KEPT) -> DataFrame:
    """The first k places for each question, with position, km (null without a location), radius_used (null unless near), open_status, secondary_only and n_candidates, the
    number of places that the filters left.

    questions: question_id, lat, lng, day_idx, sec_of_day and sort_preference, and any of near_me, open_now, category (one, or a list of which any will do), price_max, price_range ($
    to $$$$), min_rating, intents (which decide the ranking where sort_preference does not).
    Tables that several steps read are written to the shared folder.
    places: row_id, place_id, title, p_lat, p_lng, categories, category_name, price, reviews, rating, hours_raw, and others, which are passed on.
    Questions ranked by distance without a location have no rows: see unanswerable."""
    questions, category_pairs = search.interned(questions, category_pairs)
    asked, sorted_places = _tables(questions, places, category_pairs, intervals)
    near = near_answers(asked.where("near"), sorted_places, k)
    others = other_answers(asked.where("not near"), sorted_places, k)
    found = near.unionByName(others.withColumn("radius_used", F.lit(None).cast("double")))
    shown = found.join(places.hint("merge"), "row_id").join(questions.select("question_id", "lat", "lng").hint("merge"), "question_id")
    return shown.withColumn("km", _distance()).drop("lat", "lng")


def shared_answers(questions: DataFrame, places: DataFrame, category_pairs: DataFrame, intervals: DataFrame | None = None, k: int = search.KEPT) -> tuple[DataFrame, DataFrame]:
    """(question_id, ask), and the first k places of each ask, with position, km, open_status and secondary_only: an ask is what questions agree in, location included, so that
    their places are found and written once. Arguments, order and places as for answer_questions; places are read several times. How many places the filters left isn't counted."""
    questions, category_pairs = search.interned(questions, category_pairs)
    asked, sorted_places = _tables(questions, places, category_pairs, intervals)
    parts = [index_asks(asked.where("near"), F.col("located")), index_asks(asked.where("not near"), F.col("located"))]
    (near, _), (others, _) = parts
    columns = ["ask", "row_id", "position", "open_status", "secondary_only"]
    found = [near_answers(near.withColumnRenamed("ask", "question_id"), sorted_places, k).withColumnRenamed("question_id", "ask"), index_answers(others, sorted_places, k)[0]]
    # asks are numbered in both parts
    number = lambda rows, part: rows.withColumn("ask", 2 * F.col("ask") + part)
    asks = number(near, 0).unionByName(number(others, 1)).select("ask", "lat", "lng")
    shown = number(found[0].select(*columns), 0).unionByName(number(found[1].select(*columns), 1)).join(places.hint("merge"), "row_id").join(asks.hint("merge"), "ask")
    of = [number(keyed.join(a.select("key", "ask").hint("merge"), "key").select("question_id", "ask"), part) for part, (a, keyed) in enumerate(parts)]
    return of[0].unionByName(of[1]), shown.withColumn("km", _distance()).drop("lat", "lng")


def _distance() -> Column:
    return haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
