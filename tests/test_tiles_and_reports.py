"""Tiles of locations, bounds of cells without location, and the validation report over the whole catalog."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placewright.operators import discs, place_index
from placewright.queries import matching as queries
from placewright.queries.views import view


def test_most_locations_need_no_distance(monkeypatch):
    """Questions in a dense cell: counts and first places equal those of all pairs, and few of the locations have their distance taken."""
    rng, k, km = np.random.default_rng(3), 5, 0.5
    n = 30_000
    lat, lng = -1.45 + rng.integers(0, 120, n) / 10_000, -48.49 + rng.integers(0, 120, n) / 10_000
    rating = rng.integers(1, 10, n) / 2
    quality = 0.45 * rating / 5
    none = lambda t: pa.nulls(n, t)
    places = pa.table({
        "row_id": np.arange(n), "p_lat": lat, "p_lng": lng, "rating": rating, "reviews": np.zeros(n, np.int64), "asked": [""] * n, "secondary_only": np.zeros(n, bool), "main_asked": none(pa.list_(pa.string())),
        "open_slots": none(pa.list_(pa.int64())), "price": none(pa.int64()), "unknown": np.ones(n, bool), "named": np.ones(n, bool), "pop9": rating, "quality": quality,
    })
    m = 40
    q_lat, q_lng, modes = -1.447 + rng.random(m) * 0.004, -48.487 + rng.random(m) * 0.004, ["distance", "rating", "best_match", "popularity"] * 10
    asked = pa.table({
        "question_id": np.arange(m), "lat": q_lat, "lng": q_lng, "mode": modes, "category": pa.nulls(m, pa.string()), "open_now": np.zeros(m, bool), "slot": pa.nulls(m, pa.int32()),
        "price_max": pa.nulls(m, pa.float64()), "min_rating": pa.nulls(m, pa.float64()),
    })
    taken, real = [], discs._Cell.locations
    monkeypatch.setattr(discs._Cell, "locations", lambda self, *args: (taken.append(real(self, *args)), taken[-1])[1])
    names = ["question_id", "lat", "lng", "mode", *discs.OF_PLACE, "secondary_only", "open_status", "n_candidates", "f_lat", "f_lng"]
    got = discs._of_cell(km, k, 5, names)(asked, places).to_pandas()
    locations = len(set(zip(lat, lng)))
    assert sum(len(t[0]) for t in taken) < m * locations / 4
    for i in range(m):
        d = discs._haversine(q_lat[i], q_lng[i], lat, lng)
        inside = np.flatnonzero(d <= km)
        key = {"distance": (-d, rating), "best_match": (np.round(quality + 0.2 * (1 - d / d[inside].max()), 9), 0 * d)}.get(modes[i], (rating, 0 * d))
        want = inside[np.lexsort((inside, -key[1][inside], -key[0][inside]))][:k]
        own = got[got.question_id == i]
        assert set(want) <= set(own.row_id) and set(own.n_candidates) == {len(inside)} and len(own) < 4 * k
        if modes[i] == "best_match":
            assert abs(discs._haversine(q_lat[i], q_lng[i], own.f_lat.iloc[0], own.f_lng.iloc[0]) - d[inside].max()) < 1e-12


def test_cells_without_location_are_not_near(spark):
    cell = "n long, cell long, reach double, c_lat double, c_lng double, most_rating double, most_popularity double, most_quality double, least_price double, second int, unknown int, any_unknown int, any_open array<long>"
    ask = "ask long, mode string, lat double, lng double, farthest double, open_now boolean, slot int, price_max double, min_rating double, most_lead int, least_first double"
    cells = spark.createDataFrame([(1, 0, 1.0, -1.45, -48.5, 4.0, 4.0, 0.5, 1.0, 0, 0, 0, [0]), (1, 1, None, None, None, 4.0, 4.0, 0.5, 1.0, 0, 0, 0, [0])], cell)
    asks = spark.createDataFrame([(0, "distance", -1.45, -48.5, None, False, None, None, None, None, None), (1, "best_match", -1.45, -48.5, 10.0, False, None, None, None, None, None)], ask)
    found = place_index._bounded(asks.crossJoin(cells).withColumn("after", F.lit(None).cast(place_index.AFTER))).collect()
    first = {(r.ask, r["at"].cell): r["at"].first for r in found}
    assert first[0, 0] == 0 and first[0, 1] == float("inf") and abs(first[1, 0] + 0.7) < 1e-6 and abs(first[1, 1] + 0.5) < 1e-6


def test_the_report_covers_the_catalog(spark):
    data = "/root/testdata/sf0.001"
    rows = queries.validation(spark, data).collect()
    (report,), far = [r for r in rows if r.part == "report"], [r for r in rows if r.part == "mismatch"]
    places = view(spark, data, "v_places")
    assert report.places == places.count() > places.where("lat is not null").count() and report.unverified == report.places - report.verified
    assert len(far) == report.mismatches and all(r.distance_m > 150 and r.osm_id.startswith("node/") and r.title and r.osm_name for r in far)
