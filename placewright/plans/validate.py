"""A catalog against a map dump: flags, a report and the coordinates that disagree."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.operators.matching import coordinate_mismatches, match_all, validation_report
from placewright.tables import written


class Validation(NamedTuple):
    catalog: DataFrame  # with map_verified, osm_id and map_distance_m anew
    report: DataFrame  # one row of counts
    mismatches: DataFrame  # matched, but farther apart than 150 m


def validation(catalog: DataFrame, features: DataFrame, threshold_m: float = 500.0, exact: bool = False) -> Validation:
    """An empty feature set is refused; no row is deleted. features: feature_id, name, lat, lng, osm_type and osm_id. exact compares names for equality."""
    if not features.limit(1).count():
        raise ValueError("no map features: the catalog is left as it is")
    places = catalog.select("row_id", "place_id", "title", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).where("p_lat is not null and p_lng is not null")
    results = written(match_all(features, places, threshold_m, exact), "matches")
    ids = features.select("feature_id", F.concat_ws("/", "osm_type", F.col("osm_id").cast("string")).alias("osm_id")).hint("merge")
    hits = results.where("status = 'matched'").join(ids, "feature_id").select("place_id", F.lit(True).alias("__hit"), "osm_id", F.col("distance_m").alias("map_distance_m"))
    flagged = catalog.drop("map_verified", "map_distance_m", "osm_id").join(hits.hint("merge"), "place_id", "left").withColumn("map_verified", F.coalesce("__hit", F.lit(False))).drop("__hit")
    return Validation(flagged, validation_report(results), coordinate_mismatches(results, features, places))


def validate_catalog(catalog: DataFrame, features: DataFrame, threshold_m: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """The flagged catalog and the report of a validation."""
    return validation(catalog, features, threshold_m)[:2]
