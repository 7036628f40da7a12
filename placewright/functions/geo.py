"""Distances and the blocked distance join."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.tables import spread

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
#: Tasks among which the left rows of one cell are dealt.
SPREAD = 4


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within_bounds(lat: Column, lng: Column, bounds: tuple[float, float, float, float]) -> Column:
    """bounds: least and most latitude, least and most longitude, all inclusive."""
    return lat.between(bounds[0], bounds[1]) & lng.between(bounds[2], bounds[3])


def _columns_of(band: Column, tall: float) -> Column:
    """How many cells a band of latitude is cut into: none is narrower than the bands are tall, also in the bands beside it."""
    most = F.least(F.lit(90.0), (F.abs(band + 0.5) + 1.5) * tall)
    n = F.floor(360 * F.cos(F.radians(most)) / tall).cast("long")
    return F.when(n < 3, F.lit(1).cast("long")).otherwise(n)


def _column(lng: Column, columns: Column) -> Column:
    return F.least(F.floor(F.pmod(lng + 180, F.lit(360.0)) / 360 * columns), columns - 1)


def _unit(lat: str, lng: str, name: str) -> dict[str, Column]:
    """A point's unit vector, as three columns."""
    y, x = F.radians(lat), F.radians(lng)
    return {f"{name}0": F.cos(y) * F.cos(x), f"{name}1": F.cos(y) * F.sin(x), f"{name}2": F.sin(y)}


def in_cell(rows: DataFrame, km: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """The located rows with the cell that they lie in, (__y, __x): bands of latitude at least km tall, each cut into cells at least km wide."""
    tall = km / KM_PER_DEGREE * 1.01
    located = rows.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).withColumn("__y", F.floor(F.col(lat) / tall))
    return located.withColumn("__x", _column(F.col(lng), _columns_of(F.col("__y"), tall)))


def in_cells_around(rows: DataFrame, km: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """The located rows once for each cell of in_cell that may hold a point at most km away: their own and those around it, over the date line too."""
    tall = km / KM_PER_DEGREE * 1.01
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    located = rows.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    located = located.withColumn("__y", F.explode(F.transform(around, lambda d: F.floor(F.col(lat) / tall) + d)))
    columns = _columns_of(F.col("__y"), tall)
    return located.withColumn("__x", F.explode(F.when(columns == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(around, lambda d: F.pmod(_column(F.col(lng), columns) + d, columns)))))


def near_join(left: DataFrame, right: DataFrame, km: float, on: tuple[str, ...] = (), deals: int = SPREAD) -> DataFrame:
    """Pairs of rows at most km apart that agree in the columns `on`, with the distance as km. left has lat and lng, right p_lat and p_lng; rows
    without coordinates have no pair.

    Both sides are dealt into bands of latitude at least km tall and each band into cells at least km wide; each left row visits its cell
    and the eight around it, over the date line too, and an equi-join on the cell is all the shuffle there is. The left rows of a cell are dealt
    to `deals` tasks, as many more rows of right being made. Pairs are sifted by the chord between their unit vectors, and only those that pass have their distance taken."""
    asked, there = in_cells_around(left, km), in_cell(right, km, "p_lat", "p_lng")
    asked = asked.withColumns({"__s": F.pmod(F.xxhash64(*left.columns), F.lit(deals)).cast("int"), **_unit("lat", "lng", "__a")})
    there = there.withColumns({"__s": F.explode(F.sequence(F.lit(0), F.lit(deals - 1))), **_unit("p_lat", "p_lng", "__b")})
    limit = (2 * math.sin(min(km / EARTH_KM, math.pi) / 2)) ** 2
    most, sure = limit * (1 + 1e-6) + 1e-15, limit * (1 - 1e-6) - 1e-15
    chord = reduce(Column.__add__, [(F.col(f"__a{i}") - F.col(f"__b{i}")) * (F.col(f"__a{i}") - F.col(f"__b{i}")) for i in range(3)])
    keys = ["__y", "__x", "__s", *on]
    found = spread(asked, *keys).join(spread(there, *keys).hint("shuffle_hash"), keys).where(chord <= most)
    # a pair whose chord leaves no doubt has its distance taken once, as a column, and not for the filter too
    found = found.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))).where((chord <= sure) | (F.col("km") <= km))
    return found.drop("__y", "__x", "__s", *[f"__{side}{i}" for side in "ab" for i in range(3)])
