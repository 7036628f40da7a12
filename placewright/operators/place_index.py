"""The best places of many questions by an index of cells, whose bounds tell which cells a question must visit.

The places of each asked category are dealt to cells of about CELL_PLACES. By distance a cell is a square of a quadtree, as large as
its places allow; for best match it also holds one class of quality; where no location counts it holds one class of the ranked
value alone. A cell that stays too full at the smallest size is dealt by hash. Each cell carries its number of places, its
extent as a centre and a radius, its best rating, popularity, quality and price, and the slots of the week in which any of its places is open.

For a question a cell's carried values bound all its places: none can rank before the bound. Cells without a place
that may be open in its slot are left out. A question first visits its FIRST best
cells, then the next best ones, GROWTH times as many each round. Once it has k places, the k-th is a threshold, and only cells
whose bound reaches it count; when fewer are left than a round visits, it is done. So the places are exactly the first k, whatever the
filters leave. Cells lie in groups, which carry the same values. The best cells of a question's best groups give it a threshold to begin with, and then
only the cells of groups that reach it are compared with the question. Groups are compared with questions in tiles of fixed size; the
rounds are as many as the logarithm of the number of cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.geo import haversine_km
from placewright.functions.hours import open_in
from placewright.operators import search
from placewright.tables import spread, written

#: Places of a cell, cells of a question's first round, and growth of the rounds after it.
CELL_PLACES, FIRST, GROWTH = 32, 12, 10
#: A group has the cells of a square so many times doubled; groups that give a question its first threshold, and how many times more are tried.
GROUP_LEVELS, SEEDS, SEEDINGS = 3, 4, 3
#: Tasks among which the asks that look into one group are dealt.
GROUP_DEALS = 8
#: Side of the smallest cells in degrees, and how many times it may double.
FINEST, LEVELS = 0.0025, 10
#: Questions and cells that meet in one task.
TILE_ASKS, TILE_CELLS = 250, 250
#: Words of 64 slots that a cell carries: with more slots than they hold, a bit stands for several.
OPEN_WORDS = 16
#: Steps into which the value of a kind is cut: cells hold one step.
STEPS = {"best": 20, "rating": 20, "popularity": 20, "quality": 40}


def kind_of(mode: Column, located: Column) -> Column:
    """Which cells serve a question: by place, by place and quality, or by the value that ranks."""
    return F.when(mode.isin("distance", "farthest"), "spatial").when(mode.isin("rating", "popularity"), mode).when(located, "best").otherwise("quality")


def quality(rating: Column, popularity: Column) -> Column:
    """What best match takes from a place itself."""
    return 0.45 * (F.coalesce(rating, F.lit(0.0)) / 5) + 0.35 * (popularity / 5)


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], by: str, deals: int) -> DataFrame:
    """The equi-join of two tables with few keys: the right rows of a key are dealt `deals` ways by the column `by`, and the left ones go to each."""
    lefts = left.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    rights, keys = right.withColumn("__deal", F.pmod(F.xxhash64(by), F.lit(deals)).cast("int")), [*on, "__deal"]
    return spread(lefts, *keys).join(spread(rights, *keys).hint("shuffle_hash"), keys).drop("__deal")


def indexed(places: DataFrame, kinds: list[str], cell_places: int = CELL_PLACES, of_any: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of places_by_category with the cells that they lie in, once for each kind, the cells with what they carry and their group, and the groups with what they carry (as `cell`).
    of_any: the kinds of them that serve questions without a category, if not all."""
    popularity = search.bayes(F.col("rating"), F.col("reviews"))
    value = {"best": quality(F.col("rating"), popularity), "rating": F.coalesce("rating", F.lit(0.0)), "popularity": popularity, "quality": quality(F.col("rating"), popularity)}
    located = F.col("p_lat").isNotNull() & F.col("p_lng").isNotNull()
    alone = F.lit(0).cast("long")
    at = lambda c, shift: F.when(located, F.floor((F.col(c) + shift) / FINEST)).otherwise(-1).cast("long")
    of_kind = {
        kind: F.struct(
            F.lit(kind).alias("kind"), (F.floor(value[kind] * STEPS[kind]) if kind in STEPS else alone).cast("long").alias("step"),
            (at("p_lat", 90) if kind in ("spatial", "best") else alone).alias("y"), (at("p_lng", 180) if kind in ("spatial", "best") else alone).alias("x"),
        )
        for kind in kinds
    }
    served = F.array(*of_kind.values())
    if of_any is not None:
        served = F.when(F.col("asked") == search.ANY, F.array(*[of_kind[kind] for kind in of_any]) if of_any else F.slice(served, 1, 0)).otherwise(served)
    rows = places.withColumns({"popularity": popularity, "quality": value["best"], "unknown": F.coalesce(F.trim("hours_raw"), F.lit("")) == "", "second": F.coalesce(F.col("secondary_only").cast("int"), F.lit(2))})
    rows = rows.withColumn("of", F.explode(served)).select("*", "of.*").drop("of")
    by = ["kind", "asked", "second", "unknown", "step"]
    fine = rows.groupBy(*by, "y", "x").agg(F.count(F.lit(1)).alias("n"))
    up = lambda c, level: F.shiftright(c, level)  # noqa: E731  # -1, no location, stays -1
    top = ["__y", "__x"]
    fine = fine.withColumns({"__y": up("y", LEVELS - 1), "__x": up("x", LEVELS - 1)}).repartition(*by, *top)
    fine = fine.withColumns({f"__n{k}": F.sum("n").over(Window.partitionBy(*by, *top, up("y", k), up("x", k))) for k in range(1, LEVELS)})
    level = reduce(lambda low, k: F.when(F.col(f"__n{k}") <= cell_places, k).otherwise(low), range(1, LEVELS), F.lit(0))
    fine = fine.select(*by, "y", "x", level.alias("level"), F.when(level == 0, F.ceil(F.col("n") / cell_places)).otherwise(1).cast("int").alias("parts"))
    rows = rows.join(fine.hint("merge"), [*by, "y", "x"])
    corner = lambda c: F.expr(f"shiftright({c}, level)")
    rows = rows.withColumn("cell", F.xxhash64(*by, "level", corner("y"), corner("x"), F.pmod(F.xxhash64("row_id"), F.col("parts"))))
    wide = lambda c: F.expr(f"shiftright({c}, level + {GROUP_LEVELS})")
    rows = rows.withColumn("group", F.xxhash64(*by, "level", wide("y"), wide("x")))
    rows = written(rows.drop("second", "step", "y", "x", "level", "parts"), "indexed")
    of = rows.select("cell", "group").distinct().hint("merge")
    words = max(1, min(places.agg(F.max(F.size("open_slots"))).first()[0] or 1, OPEN_WORDS))
    cells = written(_carried(rows, "cell", words).drop("tile", "tiles").join(of, "cell"), "cells")
    return rows.drop("group"), cells, written(_carried(rows, "group", words).withColumnRenamed("group", "cell"), "groups")


def _carried(rows: DataFrame, what: str, words: int) -> DataFrame:
    """The cells, or groups of cells, with what they carry; any_open: a bit of `words` numbers for each slot."""
    word = lambda w: F.aggregate(F.filter("open_slots", lambda _, i: i % words == w), F.lit(0).cast("long"), lambda a, bits: a.bitwiseOR(bits))
    any_open = [F.coalesce(F.bit_or(word(w)), F.lit(0).cast("long")) for w in range(words)]
    carried = rows.groupBy("kind", "asked", what).agg(
        F.count(F.lit(1)).alias("n"), F.min("p_lat").alias("s"), F.max("p_lat").alias("t"), F.min("p_lng").alias("w"), F.max("p_lng").alias("e"), F.max("rating").alias("most_rating"),
        F.max("popularity").alias("most_popularity"), F.max("quality").alias("most_quality"), F.min(F.coalesce(F.col("price").cast("double"), F.lit(float("-inf")))).alias("least_price"),
        F.min(F.coalesce(F.col("secondary_only").cast("int"), F.lit(0))).alias("second"), F.min(F.col("unknown").cast("int")).alias("unknown"),
        F.max(F.col("unknown").cast("int")).alias("any_unknown"), F.array(*any_open).alias("any_open"),
    )
    centre = {"c_lat": (F.col("s") + F.col("t")) / 2, "c_lng": (F.col("w") + F.col("e")) / 2}
    reach = F.greatest(*[haversine_km(F.col("c_lat"), F.col("c_lng"), F.col(y), F.col(x)) for y in "st" for x in "we"]) + 1e-6
    tiles = carried.groupBy("kind", "asked").agg(F.ceil(F.count(F.lit(1)) / TILE_CELLS).cast("int").alias("tiles")).hint("merge")
    cells = carried.withColumns(centre).withColumn("reach", reach).drop("s", "t", "w", "e").join(tiles, ["kind", "asked"])
    return cells.withColumn("tile", F.pmod(F.xxhash64(what), F.col("tiles")).cast("int"))


def reaches(at: Column) -> Column:
    """Whether a cell in that place may hold one that ranks before the threshold, or there is none yet."""
    return F.col("least_first").isNull() | (at["lead"] < F.col("most_lead")) | ((at["lead"] == F.col("most_lead")) & (-at["first"] >= F.col("least_first")))


def group_bounds(asks: DataFrame, groups: DataFrame, deals: int) -> DataFrame:
    """(ask, n, at) of the groups that may hold a cell to visit, at.cell being the group. The groups of a kind and category are cut into tiles and the asks
    dealt `deals` ways; each tile meets each deal in one task."""
    asks, cells = asks.withColumn("after", F.lit(None).cast(AFTER)), groups
    tiles = cells.groupBy("kind", "asked").agg(F.max("tiles").alias("tiles")).hint("merge")
    dealt = search.by_category(asks).join(tiles, ["kind", "asked"]).withColumns({"tile": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)), "deal": F.pmod(F.xxhash64("ask"), F.lit(deals)).cast("int")})
    copies = cells.drop("tiles").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    keys = ["kind", "asked", "tile", "deal"]
    return _bounded(spread(dealt.drop("tiles"), *keys).join(spread(copies, *keys).hint("shuffle_hash"), keys))


def bounds(asks: DataFrame, groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(ask, n, at) of the cells that an ask may have to visit: those behind `after` that may hold a place, at being (lead, -first, cell): none of its places ranks before,
    and it reaches the threshold (most_lead, least_first), if there is one. groups: (ask, group), the groups that an ask has to look into."""
    of = groups.join(asks.drop("kind").hint("merge"), "ask").withColumn("deal", F.pmod(F.xxhash64("ask"), F.lit(GROUP_DEALS)).cast("int"))
    copies, keys = cells.drop("asked", "kind").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(GROUP_DEALS - 1)))), ["group", "deal"]
    return _bounded(spread(of, *keys).join(spread(copies, *keys).hint("shuffle_hash"), keys))


def _bounded(met: DataFrame) -> DataFrame:
    met = met.where(F.col("min_rating").isNull() | F.coalesce(F.col("most_rating") >= F.col("min_rating"), F.lit(False)))
    met = met.where(F.col("price_max").isNull() | (F.col("least_price") <= F.col("price_max")))
    in_slot = open_in(F.col("any_open"), F.pmod(F.col("slot"), 64 * F.size("any_open")))
    met = met.where(~F.coalesce("open_now", F.lit(False)) | (F.col("any_unknown") == 1) | in_slot)
    none = F.lit(float("-inf"))
    by = lambda mode, value: F.when(F.col("mode") == mode, value)
    # plain columns, which are compiled: a lambda over them would be interpreted for each pair
    away = haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))
    nearest, located = F.greatest(away - F.col("reach"), F.lit(0.0)), F.col("lat").isNotNull() & F.col("c_lat").isNotNull()  # greatest passes over nulls
    near = F.when(located, 1 - nearest / F.when(F.col("farthest") > 0, F.col("farthest")).otherwise(1.0)).otherwise(0.0)
    first = F.coalesce(
        by("distance", F.when(located, -nearest).otherwise(none)), by("farthest", F.coalesce(away + F.col("reach"), none)), by("rating", F.coalesce("most_rating", F.lit(0.0))),
        by("popularity", F.col("most_popularity") + 1e-9), F.col("most_quality") + 0.20 * near + 2e-9,
    )
    lead = F.when(F.col("mode") == "farthest", 0).otherwise(2 * F.col("second") + F.when(F.col("open_now"), F.col("unknown")).otherwise(0))
    found = met.select("ask", "n", "after", "most_lead", "least_first", F.struct(lead.alias("lead"), (-first).alias("first"), F.col("cell")).alias("at"))
    return found.where(reaches(F.col("at"))).where(F.col("after").isNull() | (F.col("at") > F.col("after"))).select("ask", "n", "at")


AFTER = "struct<lead:int,first:double,cell:long>"
ASK = ["ask", "kind", "mode", "lat", "lng", "farthest", "open_now", "slot", "category", "price_max", "min_rating"]


def visited(pairs: DataFrame, asks: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The first k places of each ask among those of its cells, with lead and first, the values that decide before ties."""
    there = pairs.join(asks.select(*ASK).hint("merge"), "ask").drop("kind")
    there = spread(there, "cell").join(spread(rows.drop("popularity", "kind", "asked"), "cell").hint("shuffle_hash"), "cell")
    found = search.passed(search.filter_open_at(there)).withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")))
    far = F.col("mode") == "farthest"
    lead, first, second = search.order_keys(search.score_columns(found, None), "mode")
    scored = search.score_columns(found.where(~far | F.col("km").isNotNull()), None).withColumns({
        "lead": F.when(far, 0).otherwise(reduce(lambda a, b: 2 * a + b, lead)), "first": F.when(far, F.col("km")).otherwise(first), "second": F.when(far, 0.0).otherwise(second),
    })
    return ranked(scored, k).select("ask", "row_id", "position", "open_status", "secondary_only", "km", "lead", "first", "second")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy("lead", F.desc("first"), F.desc("second"), "row_id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def best_places(asks: DataFrame, rows: DataFrame, cells: DataFrame, groups: DataFrame, k: int, first: int = FIRST, growth: int = GROWTH) -> tuple[DataFrame, DataFrame]:
    """The first k places of each ask, and how many places each has looked at, a row for each of its rounds. asks: the columns ASK, ask being unique."""
    none = {"after": AFTER, "most_lead": "int", "least_first": "double"}
    left, width, deals = asks.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}), first, max(1, -(-asks.count() // TILE_ASKS))
    found, done, looked = None, [], []
    order = F.row_number().over(Window.partitionBy("ask").orderBy("at"))
    group = F.col("at.cell").alias("group")
    least_of = lambda found: found.where(F.col("position") == k).select("ask", F.col("lead").alias("most_lead"), F.col("first").alias("least_first"))
    # the best cells of the best groups give a threshold to begin with, so that few groups are looked into for more; asks that find too few places try more groups.
    # The groups are the best of each of some classes, one of which is the best of all: that takes no sort of all pairs.
    near_first = F.min_by("at.cell", F.col("at.lead") * 1e6 + F.col("at.first"))
    start, without, turns, classes = None, left, first, SEEDS
    for _ in range(SEEDINGS):
        seeds = group_bounds(without, groups, deals).groupBy("ask", F.pmod(F.xxhash64("at.cell"), F.lit(classes)).alias("class")).agg(near_first.alias("group")).drop("class")
        seeded = written(bounds(without, written(seeds, "seeds"), cells).withColumn("turn", order).where(F.col("turn") <= turns), "pairs")
        looked.append(seeded.groupBy("ask").agg(F.sum("n").alias("places")))
        least = written(least_of(visited(seeded.select("ask", "at.cell"), without, rows, k)), "least")
        start, without = least if start is None else start.unionByName(least), without.join(least.select("ask").hint("merge"), "ask", "left_anti")
        if not without.limit(1).count():
            break
        turns, classes = turns * growth, classes * growth
    left = written(left.drop("most_lead", "least_first").join(start.hint("merge"), "ask", "left"), "asks")
    while True:
        into = group_bounds(left, groups, deals).select("ask", group)
        pairs = written(bounds(left, into, cells).withColumn("turn", order).where(F.col("turn") <= width + 1), "pairs")
        visits = pairs.where(F.col("turn") <= width)
        looked.append(visits.groupBy("ask").agg(F.sum("n").alias("places")))
        so_far = visited(visits.select("ask", "at.cell"), left, rows, k)
        if found is not None:
            so_far = ranked(so_far.unionByName(found.join(left.select("ask").hint("merge"), "ask", "left_semi")).drop("position"), k)
        found = written(so_far, "found")
        # an ask goes on if there is a next cell, and that cell may hold a better place than the k-th
        least = least_of(found)
        last = pairs.where(F.col("turn") == width).select("ask", F.col("at").alias("after"))
        more = pairs.where(F.col("turn") > width).select("ask", F.col("at").alias("next")).join(last.hint("merge"), "ask").join(least.hint("merge"), "ask", "left")
        more = more.where(reaches(F.col("next"))).drop("next")
        left = left.select(*ASK).join(more.hint("merge"), "ask")
        done.append(found.join(more.select("ask").hint("merge"), "ask", "left_anti"))
        if not more.limit(1).count():
            break
        width *= growth
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, looked)
