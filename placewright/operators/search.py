"""Set-at-a-time place search: a table of questions against a table of places.

Candidates are (question, place) rows with the distance as km. Filters are column predicates on them; the radius is settled
before any of the other place filters but the one for open places, so a near place of another kind still counts towards it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.geo import near_join, within_bounds
from placewright.functions.hours import open_in
from placewright.tables import written

RADII, ENOUGH = (0.5, 1.0, 2.0), 5
PRIOR_MEAN, PRIOR_COUNT = 3.5, 10
SHOWN, KEPT = 5, 30


def bayes(rating: Column, reviews: Column, mean: float = PRIOR_MEAN, count: int = PRIOR_COUNT) -> Column:
    return (count * mean + F.coalesce(reviews, F.lit(0)) * F.coalesce(rating, F.lit(0.0))) / (count + F.coalesce(reviews, F.lit(0)))


def by_spot(questions: DataFrame, key: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """(key, spot) of the located questions, and the spots (spot, lat, lng), each location once: what depends on the location alone is worked out for it."""
    located = questions.where("lat is not null and lng is not null").select(key, "lat", "lng")
    spots = written(located.select("lat", "lng").distinct().withColumn("spot", F.monotonically_increasing_id()), "spots")
    return written(located.join(spots.hint("merge"), ["lat", "lng"]).select(key, "spot"), "spots"), spots


def place_spots(places: DataFrame, *more: Column) -> DataFrame:
    """The locations of places with their number of places, n, and other aggregates."""
    return written(places.where("p_lat is not null and p_lng is not null").groupBy("p_lat", "p_lng").agg(F.count(F.lit(1)).alias("n"), *more), "spots")


def settle_radius(
    questions: DataFrame, places: DataFrame, stays: Callable[[DataFrame], DataFrame] = lambda pairs: pairs, radii: tuple[float, ...] = RADII, enough: int = ENOUGH, key: str = "question_id",
    weight: str | None = None,
) -> DataFrame:
    """The located questions with radius_used: the smallest radius that has enough of the pairs that stay, else the last. weight: how many places a row of places stands for.

    Pairs are counted where they are made. Only questions that lack places within a radius are joined within the next. Each step's counts are written."""
    left, settled = questions.where("lat is not null and lng is not null"), []
    for km in radii[:-1]:
        counts = stays(near_join(left, places, km)).groupBy(key).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("__n"))
        counted = written(left.join(counts.hint("merge"), key, "left"), "settled")
        has = F.coalesce(F.col("__n") >= enough, F.lit(False))
        settled.append(counted.where(has).drop("__n").withColumn("radius_used", F.lit(km)))
        left = counted.where(~has).drop("__n")
    return reduce(DataFrame.unionByName, settled, left.withColumn("radius_used", F.lit(radii[-1])))


def in_radius(settled: DataFrame, places: DataFrame, radii: tuple[float, ...] = RADII, on: tuple[str, ...] = ()) -> DataFrame:
    """Candidates within each question's radius_used (one of the radii) that agree in the columns `on`."""
    return reduce(DataFrame.unionByName, [near_join(settled.where(F.col("radius_used") == km), places, km, on) for km in radii])


def escalate_radius(pairs: DataFrame, radii: tuple[float, ...] = RADII, enough: int = ENOUGH, key: str = "question_id") -> DataFrame:
    """The same on candidates that are there already, up to the last radius: those within the settled radius; adds radius_used."""
    of = Window.partitionBy(key)
    radius = F.lit(radii[-1])
    for r in reversed(radii[:-1]):
        radius = F.when(F.sum(F.when(F.col("km") <= r, 1).otherwise(0)).over(of) >= enough, r).otherwise(radius)
    return pairs.withColumn("radius_used", radius).where(F.col("km") <= F.col("radius_used"))


def filter_open_at(candidates: DataFrame) -> DataFrame:
    """Drops places that are closed in the question's slot of the week when it asks for open ones (open_now), by their open_slots; labels
    open_status: open, unknown (nothing to read) or null (not asked)."""
    # text without any day part closes every day; only a missing text is unknown here
    status = (
        F.when(~F.coalesce("open_now", F.lit(False)), None).when(open_in(F.col("open_slots"), F.col("slot")), "open")
        .when(F.coalesce(F.trim("hours_raw"), F.lit("")) == "", "unknown").otherwise("closed")
    )
    return candidates.withColumn("open_status", status).where("open_status is null or open_status <> 'closed'")


# The price levels that a price range stands for.
PRICE_RANGES = {"$": 1, "$$": 2, "$$$": 3, "$$$$": 4}


def most_price(price_range: Column, price_max: Column) -> Column:
    """The highest price level asked for: a known range decides, else the maximum."""
    level = F.lit(None).cast("double")
    for text, n in PRICE_RANGES.items():
        level = F.when(price_range == text, float(n)).otherwise(level)
    return F.coalesce(level, price_max.cast("double"))


def filter_price(candidates: DataFrame, most: str = "price_max") -> DataFrame:
    return candidates.where(F.col(most).isNull() | F.col("price").isNull() | (F.col("price") <= F.col(most)))


def filter_rating(candidates: DataFrame, least: str = "min_rating") -> DataFrame:
    """A place without a rating fails a question that asks for one."""
    return candidates.where(F.col(least).isNull() | F.coalesce(F.col("rating") >= F.col(least), F.lit(False)))


#: What a question without a category asks for, and what a place without categories is: neither is a category's name.
ANY, UNSORTED = "", "\x00"


def asked_categories(places: DataFrame, pairs: DataFrame, key: str = "row_id") -> DataFrame:
    """Distinct (place, asked, secondary_only) with a category of the place that matches what is asked; secondary_only: its main one doesn't.
    pairs: (place_category, asked) that match."""
    each = places.select(key, F.explode("categories").alias("place_category"), F.lit(True).alias("passes"), F.lit(False).alias("main"))
    main = places.where("category_name is not null").select(key, F.col("category_name").alias("place_category"), F.lit(False).alias("passes"), F.lit(True).alias("main"))
    found = each.unionByName(main).join(pairs.select("place_category", "asked").distinct().hint("merge"), "place_category")
    tags = found.groupBy(key, "asked").agg(F.max("passes").alias("passes"), F.max("main").alias("main")).where("passes or main")
    named = places.select(key, F.col("category_name").isNotNull().alias("named"))
    return tags.join(named.hint("merge"), key).select(key, "asked", "passes", (F.col("named") & ~F.col("main")).alias("secondary_only"))


def places_by_category(places: DataFrame, pairs: DataFrame, key: str = "row_id") -> DataFrame:
    """A row of a place for each asked category that it matches, one for ANY, and one for UNSORTED if it has no categories, with secondary_only (null for
    UNSORTED, where main_asked lists what the main category matches)."""
    tags = asked_categories(places, pairs, key)
    none = F.lit(None).cast("array<string>")
    bare = F.coalesce(F.size("categories"), F.lit(0)) <= 0
    matching = tags.where("passes").drop("passes").join(places.where(~bare).hint("merge"), key).withColumn("main_asked", none)
    anything = places.withColumns({"asked": F.lit(ANY), "secondary_only": F.lit(False), "main_asked": none})
    of_main = tags.where("not secondary_only").groupBy(key).agg(F.collect_list("asked").alias("main_asked"))
    unsorted = places.where(bare).join(of_main.hint("merge"), key, "left").withColumns({"asked": F.lit(UNSORTED), "secondary_only": F.lit(None).cast("boolean")})
    return matching.unionByName(anything).unionByName(unsorted)


def by_category(questions: DataFrame, category: str = "category") -> DataFrame:
    """The questions with `asked`, once for each kind of row of places_by_category that may pass."""
    return questions.withColumn("asked", F.explode(F.when(F.col(category).isNull(), F.array(F.lit(ANY))).otherwise(F.array(F.col(category), F.lit(UNSORTED)))))


def secondary_only(category: str = "category") -> Column:
    """Of candidates that agree in `asked`: whether the place's main category isn't what was asked for."""
    by_main = F.col("category_name").isNotNull() & ~F.coalesce(F.array_contains("main_asked", F.col(category)), F.lit(False))
    return F.coalesce("secondary_only", by_main)


def passed(candidates: DataFrame) -> DataFrame:
    """Candidates that agree in `asked` and are open or needn't be, with secondary_only, after the price and rating filters."""
    return filter_rating(filter_price(candidates)).withColumn("secondary_only", secondary_only())


def interned(questions: DataFrame, pairs: DataFrame, category: str = "category") -> tuple[DataFrame, DataFrame]:
    """Questions that ask for lists of categories, and the pairs (place_category, asked), with each different list as one asked category: its key is the list as
    JSON, and what matches any of its categories matches it. An empty list asks for none. Questions with single categories are left as they are."""
    if dict(questions.dtypes).get(category, "") != "array<string>":
        return questions, pairs
    listed = F.array_sort(F.array_distinct(F.array_compact(category)))
    keyed = questions.withColumn("__list", listed).withColumn(category, F.when(F.size("__list") > 0, F.to_json("__list")))
    lists = keyed.where(F.col(category).isNotNull()).select(F.col(category).alias("__key"), F.explode("__list").alias("asked")).distinct()
    of_lists = lists.join(pairs.select("place_category", "asked").distinct().hint("merge"), "asked").select("place_category", F.col("__key").alias("asked")).distinct()
    return keyed.drop("__list"), of_lists


def filter_category(candidates: DataFrame, pairs: DataFrame, asked: str = "category", key: str = "row_id") -> DataFrame:
    """Candidates one of whose categories matches the question's; no asked category, or a place without any, passes. Adds secondary_only.

    Each place is matched with each asked category once, whatever the number of candidates."""
    places = candidates.select(key, "categories", "category_name").dropDuplicates([key])
    tags = asked_categories(places, pairs, key).select(F.col(key).alias("__place"), F.col("asked").alias("__asked"), "passes", "secondary_only")
    rows = candidates.join(tags.hint("merge"), (F.col(key) == F.col("__place")) & (F.col(asked) == F.col("__asked")), "left")
    passes = F.col(asked).isNull() | (F.coalesce(F.size("categories"), F.lit(0)) <= 0) | F.coalesce("passes", F.lit(False))
    secondary = F.col(asked).isNotNull() & F.coalesce("secondary_only", F.col("category_name").isNotNull())
    return rows.where(passes).withColumn("secondary_only", secondary).drop("__place", "__asked", "passes")


def drop_outside_location(questions: DataFrame, bounds: tuple[float, float, float, float], proximity: str = "near_me") -> DataFrame:
    """Coordinates outside the bounds are cleared; outside_notice tells those who asked for nearness."""
    inside = F.coalesce(within_bounds(F.col("lat"), F.col("lng"), bounds), F.lit(False))
    out = F.col("lat").isNotNull() & ~inside
    return questions.withColumns({
        "outside_notice": out & F.coalesce(F.col(proximity), F.lit(False)),
        "lat": F.when(inside, F.col("lat")),
        "lng": F.when(inside, F.col("lng")),
    })


def ranking_mode(sort_preference: Column, intents: Column | None = None) -> Column:
    wanted = F.lower(F.coalesce(sort_preference, F.lit("")))
    mode = F.when(F.contains(wanted, F.lit("distance")), "distance").when(F.contains(wanted, F.lit("rating")), "rating").when(F.contains(wanted, F.lit("popular")), "popularity")
    if intents is not None:
        mode = mode.when(F.array_contains(intents, "location") | F.array_contains(intents, "proximity"), "distance").when(F.array_contains(intents, "popularity"), "popularity")
    return mode.otherwise("best_match")


def filters_applied(open_now: Column, category: Column, price_max: Column, min_rating: Column) -> Column:
    names = F.array(
        F.when(F.coalesce(open_now, F.lit(False)), "open_now"), F.when(category.isNotNull(), "category"),
        F.when(price_max.isNotNull(), "price"), F.when(F.coalesce(min_rating, F.lit(0.0)) > 0, "rating"),
    )
    return F.filter(names, lambda n: n.isNotNull())


def override_slots(slots: DataFrame, given: dict[str, str]) -> DataFrame:
    """Each slot replaced by the given filter column where that is set: not null, empty, or an empty list."""
    types = dict(slots.dtypes)
    new = {}
    for slot, col in given.items():
        empty = F.col(col).isNull() | ((F.size(col) == 0) if types[col].startswith("array") else (F.col(col).cast("string") == ""))
        new[slot] = F.when(empty, F.col(slot)).otherwise(F.col(col))
    return slots.withColumns(new)


def score_columns(candidates: DataFrame, key: str | None = "question_id") -> DataFrame:
    """popularity (Bayesian mean) and best_match (rating, popularity and nearness, the farthest candidate counting as 0). With no key the candidates
    bring the distance of the farthest along, as `farthest`, or have no distances."""
    farthest = F.max("km").over(Window.partitionBy(key)) if key else F.col("farthest") if "farthest" in candidates.columns else F.lit(None).cast("double")
    near = F.coalesce(1 - F.col("km") / F.when(farthest > 0, farthest).otherwise(1.0), F.lit(0.0))
    popularity = bayes(F.col("rating"), F.col("reviews"))
    rating = F.coalesce("rating", F.lit(0.0))
    return candidates.withColumns({"popularity": popularity, "best_match": 0.45 * (rating / 5) + 0.35 * (popularity / 5) + 0.20 * near})


def order_keys(candidates: DataFrame, mode: str = "mode") -> tuple[list[Column], Column, Column]:
    """What ranks scored candidates before row_id: the leading keys, which ascend, then the mode's value and what breaks its ties, which descend."""
    zero = F.lit(0.0)
    rating, reviews = F.coalesce("rating", zero), F.coalesce("reviews", F.lit(0)).cast("double")
    by = lambda name, value: F.when(F.col(mode) == name, value)
    first = F.coalesce(by("distance", -F.coalesce("km", F.lit(float("inf")))), by("rating", rating), by("popularity", F.round("popularity", 9)), F.round("best_match", 9))
    second = F.coalesce(by("distance", rating), by("rating", reviews), zero)
    has = set(candidates.columns)
    lead = [F.col("secondary_only").cast("int")] if "secondary_only" in has else []
    lead += [F.coalesce((F.col("open_status") == "unknown").cast("int"), F.lit(0))] if "open_status" in has else []
    return lead, first, second


def rank(candidates: DataFrame, k: int = KEPT, key: str | tuple[str, ...] = "question_id", mode: str = "mode") -> DataFrame:
    """The first k candidates of each question by its mode, with their position from 1.

    What was asked for by its main category comes first, then known hours before unknown, then the mode's order, then row_id. Each map task sends on
    its own first k only."""
    lead, first, second = order_keys(candidates, mode)
    order = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*lead, first.desc(), second.desc(), "row_id")
    return candidates.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def page(ranked: DataFrame, number: int, size: int = SHOWN, kept: int = KEPT, key: str = "question_id") -> DataFrame:
    """One page of each question's list; has_more says if another follows. A page past the end has no rows."""
    total = F.least(F.count(F.lit(1)).over(Window.partitionBy(key)), F.lit(kept))
    rows = ranked.where(F.col("position") <= kept).withColumn("has_more", total > number * size)
    return rows.where((F.col("position") > (number - 1) * size) & (F.col("position") <= number * size))


def places_of(lists: DataFrame, places: DataFrame, ids: str = "ids", key: str = "question_id", place: str = "place_id") -> DataFrame:
    """The places of each list of ids, with their position from 1 in its order; ids that no place has are left out and those after them move up."""
    each = lists.select(key, F.posexplode(ids).alias("__at", place))
    found = each.join(places.hint("merge"), place)
    return found.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("__at"))).drop("__at")


# Texts of the template answer.
ANSWER = {
    "en": ("Here are the places found:\n\n", "\n\nThese are the places matching your search.", {"open": "open", "closed": "closed", "unknown": "hours unknown"},
           "I couldn't find any places matching your search. Try widening the search radius, choosing a different type, or disabling the 'open now' filter."),
    "pt-BR": ("Aqui estão os lugares encontrados:\n\n", "\n\nEstes são os lugares que correspondem à sua busca.", {"open": "aberto", "closed": "fechado", "unknown": "horário desconhecido"},
              "Não encontrei lugares que correspondam à sua busca. Tente ampliar o raio de busca, escolher um tipo diferente, ou desativar o filtro de 'aberto agora'."),
}


def render_answers(results: DataFrame, questions: DataFrame, language: str = "en", key: str = "question_id", k: int = SHOWN) -> DataFrame:
    """(question, answer): the first k results of each question as text; a question without results gets the empty answer."""
    head, foot, labels, nothing = ANSWER[language]
    part = lambda cond, *xs: F.when(cond, F.concat(*xs))
    status = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    line = F.concat_ws(
        " ",
        F.concat(F.col("position").cast("string"), F.lit(". "), F.coalesce("title", F.lit("Unknown"))),
        part(F.col("category_name") != "", F.lit("("), F.col("category_name"), F.lit(")")),
        part(F.col("address") != "", F.lit("- "), F.col("address")),
        part(F.col("km").isNotNull(), F.lit("- "), F.format_string("%.2f", F.col("km")), F.lit("km away")),
        part(F.col("rating") != 0, F.lit("- Rating: "), F.format_string("%.1f", F.col("rating")), F.lit("/5")),
        part(F.col("reviews") != 0, F.lit("("), F.col("reviews").cast("string"), F.lit(" reviews)")),
        part(F.col("open_status").isNotNull(), F.lit("- "), F.coalesce(status[F.col("open_status")], F.col("open_status"))),
    )
    lines = results.where(F.col("position") <= k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("__lines"))
    body = F.array_join(F.transform("__lines", lambda x: x["line"]), "\n")
    out = questions.select(key).join(lines, key, "left")
    return out.select(key, F.when(F.col("__lines").isNull(), nothing).otherwise(F.concat(F.lit(head), body, F.lit(foot))).alias("answer"))
