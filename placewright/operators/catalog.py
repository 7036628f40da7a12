"""Cleaning of a raw places export: one row for each place, with the counts of what was mended."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.geo import within_bounds
from placewright.functions.hours import hours_outcome, parse_hours
from placewright.functions.text import clean_bool, clean_int, clean_num, clean_str, fold, garbled, recase_title

# The address spellings in order of preference, and the words of each place type.
ADDRESSES = ("address", "addressFormatted", "adressFormatted", "formattedAddress")
TYPE_WORDS = {
    "restaurant": ("restaurant", "restaurante", "steakhouse", "pizza", "pizzaria", "sushi", "churrascaria", "buffet", "cafe", "café", "coffee", "snack bar"),
    "bar": ("bar", "pub", "brewery", "cervejaria", "boteco"),
    "park": ("park", "parque", "garden", "jardim", "praça", "praca"),
}
# Words that stay small inside a title.
SMALL_WORDS = ("a", "à", "as", "ao", "aos", "o", "os", "e", "é", "da", "das", "de", "do", "dos", "em", "na", "nas", "no", "nos", "por", "pra", "com", "sem")


@dataclass(frozen=True)
class City:
    """What a catalog build needs to know of its city."""

    name: str
    state: str
    municipalities: tuple[str, ...]
    bounds: tuple[float, float, float, float]  # least and most latitude, least and most longitude
    timezone: str = "UTC"
    small_words: tuple[str, ...] = SMALL_WORDS


def text_or_null(df: DataFrame, name: str) -> Column:
    return clean_str(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("string")


def build_categories(df: DataFrame) -> Column:
    """The numbered category columns that hold something, in order, led by the category name unless it is among them."""
    listed = F.array_compact(F.array(*[text_or_null(df, f"categories/{i}") for i in range(9)]))
    name = text_or_null(df, "categoryName")
    return F.when(name.isNull() | F.array_contains(listed, F.coalesce(name, F.lit(""))), listed).otherwise(F.array_prepend(listed, name))


def infer_place_type(name: Column, categories: Column) -> Column:
    """Type of the longest phrase found as whole words in the first candidate that has one (name, then categories); ties go to the earlier type."""
    ranked = sorted(((kind, word) for kind, words in TYPE_WORDS.items() for word in words), key=lambda kw: -len(kw[1].split()))

    def match(candidate: Column) -> Column:
        words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(fold(candidate), F.lit("([a-z0-9]+)"), F.lit(1)), " "), F.lit(" "))
        out = F.lit(None).cast("string")
        for kind, word in reversed(ranked):
            out = F.when(F.contains(words, F.lit(f" {word.replace('é', 'e').replace('ç', 'c')} ")), kind).otherwise(out)
        return out

    found = F.filter(F.transform(F.concat(F.array(name), categories), match), lambda t: t.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit("other"))


def unify_address(df: DataFrame) -> tuple[Column, Column]:
    """The first address spelling that holds something, and whether it came from another than the first."""
    found = F.coalesce(*[text_or_null(df, c) for c in ADDRESSES])
    return found, found.isNotNull() & text_or_null(df, "address").isNull()


def to_canonical(export: DataFrame) -> DataFrame:
    """Export strings as typed place columns; rows without an id are left in, with a null place_id."""
    address, alternative = unify_address(export)
    # exports spell the flag both ways; the reader numbers names that differ in case only
    sponsored = F.lit(False)
    for c in export.columns:
        if re.fullmatch(r"(?i)issponsored\d*", c):
            sponsored = sponsored | clean_bool(F.col(f"`{c}`"))
    number = lambda c: clean_num(F.col(f"`{c}`")) if c in export.columns else F.lit(None).cast("double")
    out = export.select(
        "row_id", text_or_null(export, "placeId").alias("place_id"), text_or_null(export, "title").alias("title_raw"), text_or_null(export, "categoryName").alias("category_name"),
        build_categories(export).alias("categories"), address.alias("address"), alternative.alias("address_from_alt"),
        text_or_null(export, "neighborhood").alias("neighborhood"), F.trim("city").alias("city_raw"), F.trim("state").alias("state_raw"),
        number("location/lat").alias("lat"), number("location/lng").alias("lng"), text_or_null(export, "phone").alias("phone"), text_or_null(export, "website").alias("website"),
        text_or_null(export, "url").alias("url"), number("price").alias("price"), number("totalScore").alias("rating"), clean_int(F.col("reviewsCount")).alias("reviews"),
        sponsored.alias("is_sponsored"), text_or_null(export, "businessTime").alias("hours_raw"),
    )
    return out.withColumn("place_type", infer_place_type(F.col("category_name"), F.col("categories")))


def dedupe_places(places: DataFrame) -> DataFrame:
    """One row for each id: the most reviewed (the first of equals), at the place of the id's first row, with the categories of all
    its rows (its own first, then in row order) and, if rows were merged, the type anew. Adds merged: rows that went into it besides."""
    order = F.struct(F.coalesce("reviews", F.lit(0)).alias("reviews"), (-F.col("row_id")).alias("row"))
    body = [c for c in places.columns if c not in ("place_id",)]
    kept = places.groupBy("place_id").agg(F.max_by(F.struct(*body), order).alias("k"), F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    names = places.select("place_id", "row_id", F.posexplode("categories").alias("at", "category"))
    keepers = kept.select("place_id", F.col("k.row_id").alias("kept_row"))
    first = names.join(keepers.hint("merge"), "place_id").groupBy("place_id", "category").agg(
        F.min(F.struct((F.col("row_id") != F.col("kept_row")).cast("int").alias("other"), "row_id", "at")).alias("seen")
    )
    union = first.groupBy("place_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "category"))), lambda x: x["category"]).alias("all_categories"))
    out = kept.join(union.hint("merge"), "place_id", "left").select("place_id", "k.*", "n", "first_row", "all_categories")
    categories = F.when(F.col("n") > 1, F.coalesce("all_categories", "categories")).otherwise(F.col("categories"))
    out = out.withColumn("categories", categories)
    again = infer_place_type(F.col("category_name"), F.col("categories"))
    return out.withColumns({"place_type": F.when(F.col("n") > 1, again).otherwise(F.col("place_type")), "merged": F.col("n") - 1, "row_id": F.col("first_row")}).drop("n", "first_row", "all_categories")


def in_municipality(value: Column, names: tuple[str, ...]) -> Column:
    """Whether a city text names one of the names, by folded equality; a ? in it stands for any one character."""
    pattern = F.concat(F.lit("^"), F.replace(F.regexp_replace(fold(value), r"([^\p{L}\p{N}? ])", r"\\$1"), F.lit("?"), F.lit(".")), F.lit("$"))
    hit = F.lit(False)
    for name in names:
        hit = hit | F.rlike(fold(F.lit(name)), pattern)
    return F.coalesce(hit, F.lit(False))


def repair_titles(places: DataFrame, repairs: DataFrame, city: City) -> DataFrame:
    """title from the repairs where the raw one is garbled, re-cased; flags what was done and what needs review."""
    rows = places.join(repairs.select("place_id", F.col("title").alias("__fixed")).hint("merge"), "place_id", "left")
    bad = garbled(F.coalesce("title_raw", F.lit("")))
    title = F.when(bad & F.col("__fixed").isNotNull(), F.col("__fixed")).otherwise(F.coalesce("title_raw", F.lit("")))
    rows = rows.withColumns({"title_repaired": bad & F.col("__fixed").isNotNull(), "needs_review": bad & F.col("__fixed").isNull(), "__title": title})
    cased = recase_title(F.col("__title"), city.small_words)
    return rows.withColumns({"title": cased, "title_cased": cased != F.col("__title")}).drop("__title", "__fixed")


def clean_places(export: DataFrame, repairs: DataFrame, city: City) -> DataFrame:
    """All rows of a build: places with their flags, and the dropped ones with the reason in `dropped`."""
    rows = to_canonical(export)
    merged = dedupe_places(rows.where(F.col("place_id").isNotNull()))
    inside = in_municipality(F.col("city_raw"), city.municipalities) & (F.col("lat").isNull() | F.col("lng").isNull() | within_bounds(F.col("lat"), F.col("lng"), city.bounds))
    merged = repair_titles(merged.withColumn("outside", ~inside), repairs, city)
    merged = hours_outcome(merged, parse_hours(merged.select(F.trim(F.replace("hours_raw", F.lit(" "), F.lit(" "))).alias("hours_raw"))))
    no_reviews = (F.col("reviews") == 0) & F.col("rating").isNotNull()
    return merged.withColumns({
        "rating_nulled": no_reviews,
        "rating": F.when(~no_reviews, F.col("rating")),
        "city_normalized": (F.coalesce("city_raw", F.lit("")) != city.name) | (F.coalesce("state_raw", F.lit("")) != city.state),
        "city": F.lit(city.name),
        "state": F.lit(city.state),
    })


def catalog_columns(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(~F.col("outside")).select(
        "row_id", "place_id", "title", "title_raw", "categories", "category_name", "place_type", "address", "neighborhood", "city", "state", "lat", "lng", "phone", "website", "url",
        "rating", "reviews", "is_sponsored", F.col("hours_clean").alias("hours_raw"), "hours_status", "needs_review",
    )


def cleaning_report(export: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row of counts; input_rows = kept + merged_duplicates + dropped."""
    inn = ~F.col("outside")
    n = lambda cond: F.coalesce(F.sum((inn & cond).cast("long")), F.lit(0)).alias
    counts = cleaned.agg(
        n(F.lit(True))("kept"), F.coalesce(F.sum("merged"), F.lit(0)).alias("merged_duplicates"), F.coalesce(F.sum(F.col("outside").cast("long")), F.lit(0)).alias("outside_municipality_dropped"),
        n(F.col("city_normalized"))("city_state_normalized"), n(F.col("address_from_alt"))("addresses_unified"), n(F.col("title_repaired"))("titles_repaired_from_raw"),
        n(F.col("needs_review"))("titles_flagged_needs_review"), n(F.col("title_cased"))("titles_title_cased"), n(F.col("hours_status") == "parsed")("hours_parsed"),
        n(F.col("hours_status") != "parsed")("hours_unknown"), n(F.col("hours_status") == "garbage")("hours_garbage_cleared"), n(F.col("rating_nulled"))("zero_review_ratings_nulled"),
        n(F.col("is_sponsored"))("sponsor_flags_unified"),
    )
    rows = export.agg(F.count(F.lit(1)).alias("input_rows"), F.coalesce(F.sum(text_or_null(export, "placeId").isNull().cast("long")), F.lit(0)).alias("null_place_id_dropped"))
    both = rows.crossJoin(counts)  # one row each
    return both.withColumn("dropped", F.col("null_place_id_dropped") + F.col("outside_municipality_dropped"))


def serving(catalog: DataFrame) -> DataFrame:
    """The catalog as the search takes it; no price is carried."""
    return catalog.select(
        "row_id", "place_id", "title", "categories", "category_name", "place_type", "address", "neighborhood", "city", "state", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"),
        "phone", "website", "url", "rating", "reviews", "is_sponsored", "hours_raw", F.lit(None).cast("double").alias("price"),
    )


def title_search(catalog: DataFrame, terms: DataFrame, query_col: str = "query") -> DataFrame:
    """(query, place_id, title) of the places whose title holds all words of a query, whatever the accents and case."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    titles = catalog.select("place_id", "title", F.explode(words(F.col("title"))).alias("word"))
    asked = terms.select(query_col, words(F.col(query_col)).alias("__words"))
    asked = asked.select(query_col, F.size("__words").alias("__n"), F.explode("__words").alias("word"))
    found = asked.join(titles.hint("shuffle_hash"), "word").groupBy(query_col, "place_id", "title", "__n").agg(F.count(F.lit(1)).alias("__hits"))
    return found.where("__hits = __n").select(query_col, "place_id", "title")


def first_seen(df: DataFrame, keys: tuple[str, ...], order: str = "row_id") -> DataFrame:
    """The first row of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__at", at).where("__at = 1").drop("__at")
