"""A places export in, a clean catalog and its report out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from placewright.operators.catalog import City, catalog_columns, clean_places, cleaning_report


def build_catalog(export: DataFrame, repairs: DataFrame, city: City) -> tuple[DataFrame, DataFrame]:
    cleaned = clean_places(export, repairs, city)
    return catalog_columns(cleaned), cleaning_report(export, cleaned)
