"""Located questions against the places within their radius, location by location.

Questions lie in cells as wide as the radius, and places visit the cells around theirs, so that one task has a cell's questions and all places in their
reach. The questions that agree in filters and ranking share what the filters leave at each location, and in each tile of locations: how many places, and the best
of them. Tiles that lie within the radius as a whole need no distances but those of the few that may hold one of the first k. The k locations with the best places hold the
first k, so only their places leave the task. What leaves is a few rows more than k, where rounding could decide; the caller ranks them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.functions.geo import EARTH_KM, KM_PER_DEGREE, haversine_km, in_cell, in_cells_around
from placewright.operators import search
from placewright.tables import spread, written

#: Questions of one cell that meet its places in one task, and pairs of questions and tiles held at a time.
DEAL, HELD = 1 << 15, 1 << 17
#: The more, the fewer tiles: a radius is as wide as the third root of places / FINE tiles.
FINE = 50
#: What a leading key outweighs, and how far rounding may reach in each mode's value (others are whole numbers).
LEAD, SLACK = 10.0, {"distance": 1e-13, "best_match": 1e-8}
FILTERS = ["mode", "category", "open_now", "slot", "price_max", "min_rating"]
OF_PLACE = ["row_id", "p_lat", "p_lng", "rating", "reviews"]


def _unit(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    y, x = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])


def _haversine(lat1, lng1, lat2, lng2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return EARTH_KM * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


class _Cell:
    """The places of one cell's reach, in columns, with what sets of filters leave of them. Locations are numbered tile by tile; a tile has the mean of its
    locations' unit vectors and how far they lie from it, so that by its chord most tiles are known to lie within a radius, or not, as a whole."""

    def __init__(self, places: pa.Table, k: int, km: float):
        col = lambda c: places[c].to_numpy()
        self.k, self.n, lat, lng = k, places.num_rows, col("p_lat"), col("p_lng")
        fine = min(max(round((self.n / FINE) ** (1 / 3)), 4), 64)
        side = km / KM_PER_DEGREE / fine
        y, x = np.floor(lat / side), np.floor(lng * max(math.cos(math.radians(float(np.median(lat)))), 0.01) / side)
        by = np.lexsort((lng, lat, x, y))
        differs = lambda *columns: np.r_[True, np.logical_or.reduce([np.diff(c[by]) != 0 for c in columns])][: self.n]
        new = differs(lat, lng)
        self.spot = np.empty(self.n, np.int64)
        self.spot[by] = np.cumsum(new) - 1
        at = by[new]  # a place of each location
        self.lat, self.lng, self.unit = lat[at], lng[at], _unit(lat[at], lng[at])
        self.tiles = np.r_[np.flatnonzero(differs(x, y)[new]), len(at)]  # where each begins
        self.rows, self.side = y[at][self.tiles[:-1]], side
        size = np.diff(self.tiles)
        self.centre = np.stack([np.add.reduceat(u, self.tiles[:-1]) / size for u in self.unit])
        self.reach = np.sqrt(np.maximum.reduceat(sum((u - np.repeat(c, size)) ** 2 for u, c in zip(self.unit, self.centre, strict=True)), self.tiles[:-1]))
        self.rating, self.price, self.unknown = (col(c).astype(float) for c in ("rating", "price", "unknown"))
        self.second = places["secondary_only"].cast("int8").to_numpy().astype(float)  # nan: decided by the question
        self.named, self.main_asked = col("named"), places["main_asked"]
        asked = places["asked"].combine_chunks().dictionary_encode()
        code = asked.indices.to_numpy()
        self.asked = {a: np.flatnonzero(code == i) for i, a in enumerate(asked.dictionary.to_pylist())}
        self.order = np.asarray(pc.rank(places["row_id"].combine_chunks(), tiebreaker="first")).astype(np.int64)
        zero = np.zeros(self.n)
        rated = np.nan_to_num(self.rating)
        self.value = {"distance": (zero, rated), "rating": (rated, col("reviews").astype(float)), "popularity": (col("pop9"), zero), "best_match": (col("quality"), zero)}
        slots = places["open_slots"].combine_chunks()
        self.slots_at, self.slots_n = slots.offsets.to_numpy()[:-1], np.nan_to_num(pc.list_value_length(slots).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        self.bits = slots.values.to_numpy(zero_copy_only=False)
        self.sorted: dict = {}
        self.every = self.asked.get(search.ANY, np.zeros(0, np.int64))
        self.open: dict = {}
        self.alike: dict = {}

    def open_at(self, slot: float) -> np.ndarray:
        """Which places are open in the slot."""
        if math.isnan(slot):
            return np.zeros(self.n, bool)
        word, bit = divmod(int(slot), 64)
        held, out = self.slots_n > word, np.zeros(self.n, bool)
        out[held] = self.bits[self.slots_at[held] + word] >> bit & 1 == 1
        return out

    def first_alike(self, slot: float) -> float:
        """The first slot met in which the same of these places are open."""
        return self.alike.setdefault(hashlib.sha256(np.packbits(self.open_at(slot)).tobytes()).digest(), slot)

    def staying(self, open_now: bool, slot: float) -> tuple[np.ndarray, np.ndarray]:
        """Which places are open in the slot or needn't be, and how many of them each location has: worked out once for all sets of filters that agree in it."""
        slot = slot if open_now and not math.isnan(slot) else -1.0
        if (open_now, slot) not in self.open:
            stay = self.open_at(slot if slot >= 0 else math.nan) | (self.unknown == 1) if open_now else np.ones(self.n, bool)
            self.open[open_now, slot] = stay, np.bincount(self.spot[self.every[stay[self.every]]], minlength=len(self.lat))
        return self.open[open_now, slot]

    def in_order(self, mode: str, category: str | None, open_now: bool) -> tuple[np.ndarray, ...]:
        """The places that the category leaves by location and, within it, as they rank there; their leading keys, secondary_only, and rank among all of them."""
        if (mode, category, open_now) not in self.sorted:
            none = np.zeros(0, np.int64)
            rows = self.asked.get(search.ANY, none) if category is None else np.concatenate([self.asked.get(category, none), self.asked.get(search.UNSORTED, none)])
            second = self.second[rows]
            for i in np.flatnonzero(np.isnan(second)):
                second[i] = bool(self.named[rows[i]]) and category not in (self.main_asked[int(rows[i])].as_py() or [])
            lead = 2 * second + (self.unknown[rows] if open_now else 0)
            first, then = (v[rows] for v in self.value[mode])
            ranks = np.empty(len(rows))
            ranks[np.lexsort((self.order[rows], -then, -first, lead))] = np.arange(len(rows))
            by = np.lexsort((ranks, self.spot[rows]))
            self.sorted[mode, category, open_now] = rows[by], lead[by], second[by] == 1, ranks[by]
        return self.sorted[mode, category, open_now]

    def locations(self, which: np.ndarray, begin: int, has: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions and locations of the tiles `which` (questions by tiles from `begin` on) for locations that have places, and their squared chords."""
        q, tile = np.nonzero(which)
        pair, s = _runs(self.tiles[tile + begin], np.diff(self.tiles)[tile + begin])
        some = has[s]
        q, s = q[pair[some]], s[some]
        return q, s, sum((a[q] - b[s]) ** 2 for a, b in zip(unit, self.unit, strict=True))


def _runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of runs that begin at start, and the run of each."""
    run = np.repeat(np.arange(len(start)), size)
    return run, start[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)


def _answers(cell: _Cell, all_lat: np.ndarray, all_lng: np.ndarray, rows: np.ndarray, filters: dict, km: float, enough: int | None) -> tuple[np.ndarray, tuple | None]:
    """Of the questions `rows`, which agree in filters: those that lack places, and the best places of the others.

    Tiles that lie within the radius as a whole are counted as one, and of the locations of others the distance is taken. The k-th of what tiles within
    the radius have at least is a threshold, and only the locations of tiles that may reach it are ranked."""
    mode, open_now, k, slack = filters["mode"], filters["open_now"], cell.k, SLACK.get(filters["mode"], 0.0)
    stay, around = cell.staying(open_now, filters["slot"])
    near, lead, second, ranks = cell.in_order(mode, filters["category"], open_now)
    left = stay[near]
    if not math.isnan(filters["price_max"]):
        left &= ~(cell.price[near] > filters["price_max"])
    if not math.isnan(filters["min_rating"]):
        left &= cell.rating[near] >= filters["min_rating"]
    near, lead, second, ranks = near[left], lead[left], second[left], ranks[left]
    spots, begins = len(cell.lat), cell.tiles[:-1]
    own = {"distance": -LEAD * lead, "best_match": cell.value["best_match"][0][near] - LEAD * lead}.get(mode, -ranks)
    n = np.bincount(cell.spot[near], minlength=spots)
    start = np.r_[0, np.cumsum(n)]
    best = np.full(spots, -np.inf)
    best[n > 0] = own[start[:-1][n > 0]]
    weights = np.stack([around, n], 1).astype(float)
    tile_weights, tile_best = np.add.reduceat(weights, begins, axis=0), np.maximum.reduceat(best, begins)
    has, any_place = n > 0, weights.any(axis=1)
    limit = (2 * math.sin(min(km / EARTH_KM, math.pi) / 2)) ** 2
    most, sure = limit * (1 + 1e-6) + 1e-15, limit * (1 - 1e-6) - 1e-15

    def way(chord: np.ndarray, far: np.ndarray) -> np.ndarray | float:
        """What a chord adds to a place's own value; far: the distance of the farthest place."""
        if mode == "distance":
            return -chord
        return 0.20 * (1 - 2 * EARTH_KM * np.arcsin(np.minimum(chord / 2, 1)) / far) if mode == "best_match" else np.zeros(chord.shape)

    # questions and tiles in order of latitude: those at hand meet a band of tiles
    rows = rows[np.argsort(all_lat[rows], kind="stable")]
    lat, lng, tall = all_lat[rows], all_lng[rows], km / KM_PER_DEGREE * 1.01
    lacks, found = np.zeros(len(rows), bool), []
    step = max(1, HELD // max(len(begins), spots // 8, 1))
    for a in range(0, len(rows), step):
        part = slice(a, a + step)
        ends = np.floor(np.array([lat[part][0] - tall, lat[part][-1] + tall]) / cell.side)
        band = slice(np.searchsorted(cell.rows, ends[0]), np.searchsorted(cell.rows, ends[1], "right"))
        unit, reach, on = _unit(lat[part], lng[part]), cell.reach[band], band.start
        chord = np.sqrt(sum((p[:, None] - c[None, :]) ** 2 for p, c in zip(unit, cell.centre[:, band], strict=True)))
        inner = chord + reach <= math.sqrt(max(sure, 0)) - 1e-13
        q, s, rim = cell.locations(~inner & (chord - reach <= math.sqrt(most) + 1e-13), on, any_place, unit)
        inside = rim <= most
        doubt = np.flatnonzero(inside & (rim > sure))
        inside[doubt] = _haversine(lat[part][q[doubt]], lng[part][q[doubt]], cell.lat[s[doubt]], cell.lng[s[doubt]]) <= km
        q, s, rim = q[inside], s[inside], np.sqrt(rim[inside])
        counts = inner.astype(float) @ tile_weights[band]
        for i in range(2):
            counts[:, i] += np.bincount(q, weights[s, i], minlength=len(counts))
        if enough is not None:
            lacks[part] = counts[:, 0] < enough
        asks = np.flatnonzero(~lacks[part] & (counts[:, 1] > 0))
        if not len(asks):
            continue
        to = np.full(len(counts), -1)
        to[asks] = np.arange(len(asks))
        some = (to[q] >= 0) & has[s]
        q, s, rim = to[q[some]], s[some], rim[some]
        chord, inner, unit, counts = chord[asks], inner[asks] & (tile_weights[band, 1] > 0), unit[:, asks], counts[asks, 1].astype(np.int64)
        far, outmost = np.ones(len(asks)), np.full(len(asks), -1)
        if mode == "best_match":
            least = np.where(inner, chord - reach, 0.0).max(axis=1, initial=0.0)
            np.maximum.at(least, q, rim)
            q2, s2, chord2 = cell.locations(inner & (chord + reach >= least[:, None] - 1e-13), on, has, unit)
            q2, s2, chord2 = np.r_[q, q2], np.r_[s, s2], np.r_[rim, np.sqrt(chord2)]
            by = np.lexsort((chord2, q2))
            last = by[np.searchsorted(q2[by], np.arange(len(asks)), "right") - 1]  # each has a place
            outmost, away = s2[last], 2 * EARTH_KM * np.arcsin(np.minimum(chord2[last] / 2, 1))
            far = np.where(away > 0, away, 1.0)
        least = np.full(len(asks), -np.inf)
        if chord.shape[1] > k:
            least = np.partition(np.where(inner, tile_best[band] + way(chord + reach, far[:, None]), -np.inf), -k, axis=1)[:, -k] - slack - 1e-13
        may = inner & (tile_best[band] + way(np.maximum(chord - reach, 0), far[:, None]) >= least[:, None] - 1e-13)
        q2, s2, chord2 = cell.locations(may, on, has, unit)
        q, s, rim = np.r_[q, q2], np.r_[s, s2], np.r_[rim, np.sqrt(chord2)]
        ways = way(rim, far[q])
        key = best[s] + ways
        some = np.flatnonzero(key >= least[q])
        some = some[np.lexsort((-key[some], q[some]))]
        q, s, ways, key = q[some], s[some], ways[some], key[some]
        first = np.searchsorted(q, np.arange(len(asks) + 1))
        least = np.where(np.diff(first) >= k, key[np.minimum(first[:-1] + k - 1, len(key) - 1)] - slack, -np.inf)
        some = key >= least[q]
        q, s, ways = q[some], s[some], ways[some]
        # the places of those locations, a few rows each
        pair, at = _runs(start[s], n[s] if mode == "best_match" else np.minimum(n[s], k))
        key, pair = own[at] + ways[pair], q[pair]
        some = key >= least[pair]
        pair, at, key = pair[some], at[some], key[some]
        by = np.lexsort((-key, pair))
        pair, at, key = pair[by], at[by], key[by]
        first = np.searchsorted(pair, np.arange(len(asks)))
        last = np.minimum(first + k, np.r_[first[1:], len(pair)]) - 1
        some = key >= key[last][pair] - slack
        pair, at = pair[some], at[some]
        found.append((rows[a + asks[pair]], near[at], second[at], counts[pair], outmost[pair]))
    if not found:
        return rows[lacks], None
    ask, place, second, counts, far = (np.concatenate(x) for x in zip(*found, strict=True))
    status = np.where(cell.unknown[place] == 1, 1, 0) if open_now else np.full(len(place), -1)
    return rows[lacks], (ask, place, second, status, counts, far)


def _of_cell(km: float, k: int, enough: int | None, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def of(asked: pa.Table, places: pa.Table) -> pa.Table:
        lacks, out = np.zeros(asked.num_rows, bool), []
        if places.num_rows and asked.num_rows:
            cell = _Cell(places, k, km)
            lat, lng, sets = asked["lat"].to_numpy(), asked["lng"].to_numpy(), asked.select(FILTERS).to_pandas()
            slots = sets["slot"].astype(float)
            sets["slot"] = slots.map({slot: cell.first_alike(slot) for slot in slots.dropna().unique()})
            code = sets.groupby(FILTERS, dropna=False, sort=False).ngroup().to_numpy()
            by = np.argsort(code, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(code[by])) + 1):
                one = sets.iloc[rows[0]]
                filters = {**{c: float("nan") if one[c] is None else float(one[c]) for c in ("slot", "price_max", "min_rating")}, "mode": one["mode"], "open_now": bool(one["open_now"]),
                           "category": one["category"] if isinstance(one["category"], str) else None}
                without, found = _answers(cell, lat, lng, rows, filters, km, enough)
                lacks[without] = True
                if found is not None:
                    out.append(found)
        elif enough is not None:
            lacks[:] = True
        own = asked.select(["question_id", "lat", "lng", "mode"])
        without = own.take(np.flatnonzero(lacks))
        columns = [c.combine_chunks() for c in without.columns]
        nulls = lambda t: pa.nulls(without.num_rows, t)
        columns += [nulls(places.schema.field(c).type) for c in OF_PLACE] + [nulls(t) for t in (pa.bool_(), pa.string(), pa.int64(), pa.float64(), pa.float64())]
        parts = [pa.table(columns, names=names)]
        if out:
            ask, place, second, status, counts, far = (np.concatenate(x) for x in zip(*out, strict=True))
            status = pa.array(["open", "unknown"]).take(pa.array(status, mask=status < 0))
            f_lat, f_lng = (pa.array(c[far], mask=far < 0) for c in (cell.lat, cell.lng))
            parts.append(pa.table([*own.take(ask).columns, *places.select(OF_PLACE).take(place).columns, pa.array(second), status, pa.array(counts), f_lat, f_lng], names=names))
        return pa.concat_tables(parts)

    return of


def best_in_radius(questions: DataFrame, places: DataFrame, k: int, radii: tuple[float, ...] = search.RADII, enough: int = search.ENOUGH) -> DataFrame:
    """The first k places of each located question within its radius, and a few more where rounding could decide: question_id, lat, lng, mode, those columns of OF_PLACE,
    secondary_only, open_status, n_candidates, farthest (both of all places that the filters leave; farthest for best match only) and radius_used, the smallest radius with enough places that are open or needn't be, or the last.

    questions: question_id, lat, lng and FILTERS; places: rows of places_by_category with open_slots. Only questions that lack places within a radius are searched within the next."""
    popularity = search.bayes(F.col("rating"), F.col("reviews"))
    slim = places.select(
        *OF_PLACE, "asked", "secondary_only", "main_asked", "open_slots", "price", (F.coalesce(F.trim("hours_raw"), F.lit("")) == "").alias("unknown"), F.col("category_name").isNotNull().alias("named"),
        F.round(popularity, 9).alias("pop9"), (0.45 * (F.coalesce("rating", F.lit(0.0)) / 5) + 0.35 * (popularity / 5)).alias("quality"),
    ).withColumn("reviews", F.coalesce("reviews", F.lit(0)).cast("long"))
    # lists that are null cost a pass over the batch for each row as it is handed to Python
    slim = slim.withColumns({c: F.coalesce(c, F.array().cast(dict(slim.dtypes)[c])) for c in ("main_asked", "open_slots")})
    left = questions.where("lat is not null and lng is not null").select("question_id", "lat", "lng", *FILTERS)
    done = []
    types = {**dict(left.dtypes), **dict(slim.dtypes), "open_status": "string", "n_candidates": "long", "f_lat": "double", "f_lng": "double"}
    names = ["question_id", "lat", "lng", "mode", *OF_PLACE, "secondary_only", "open_status", "n_candidates", "f_lat", "f_lng"]
    for km in radii:
        last = km == radii[-1]
        asked = in_cell(left, km).withColumn("__h", F.xxhash64("question_id"))
        cells = written(asked.groupBy("__y", "__x").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("__deals")), "cells")
        asked = asked.join(cells.hint("merge"), ["__y", "__x"]).withColumn("__deal", F.pmod("__h", "__deals").cast("int")).drop("__h", "__deals")
        there = in_cells_around(slim, km, "p_lat", "p_lng").join(cells.hint("merge"), ["__y", "__x"])
        there = there.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1))).drop("__deals")
        keys = ["__y", "__x", "__deal"]
        met = spread(asked, *keys).groupBy(*keys).cogroup(spread(there, *keys).groupBy(*keys))
        found = written(met.applyInArrow(_of_cell(km, k, None if last else enough, names), ", ".join(f"{c} {types[c]}" for c in names)), "found")
        done.append(found.where("row_id is not null").withColumn("radius_used", F.lit(km)))
        if last:
            break
        lacking = found.where("row_id is null").select("question_id")
        if not lacking.limit(1).count():
            break
        left = written(left.join(lacking.hint("merge"), "question_id", "left_semi"), "left")
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    farthest = haversine_km(F.col("lat"), F.col("lng"), F.col("f_lat"), F.col("f_lng"))
    return rows.withColumn("farthest", farthest).drop("f_lat", "f_lng")
