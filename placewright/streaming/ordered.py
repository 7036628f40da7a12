"""Streams whose rows come out of order, taken in order of event time.

A key's rows wait in its state until the watermark has passed them, then a timer takes all that are ready, in order of (ts_us, event_id),
through the same step that a batch twin uses. What waits is at most what comes within the watermark's delay. A row that comes later than
that meets no state at all: Spark drops it and counts it (numRowsDroppedByWatermark of the query's progress; see late_rows). A key's state goes
when it has been idle for keep_s, by a timer as well.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from placewright.operators.conversations import IDLE_S, QUESTIONS, local_day
from placewright.streaming.limits import CHAT_FIELDS, EMPTY, HIT_FIELDS, LIMIT, WATERMARK, WINDOW_S, chat_turn, take_hits

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(value):
    """A value as the state store takes it: no numpy scalars or arrays."""
    if isinstance(value, np.generic):
        return value.item()
    return [plain(x) for x in value] if isinstance(value, list | tuple | np.ndarray) else None if value is pd.NaT else value


class InOrder(StatefulProcessor):
    """Rows (ts_us, event_id, *fields) of a key through step(key, state, row) -> (state, output row), in order of event time."""

    def __init__(self, fields: str, state: str, columns: list[str], out: list[str], empty: tuple, step: Callable, keep_s: int):
        self.fields, self.state, self.columns, self.out, self.empty, self.step, self.keep_us = fields, state, columns, out, empty, step, keep_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.held = handle.getValueState("held", f"{self.state}, last_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [tuple(plain(r)) for part in rows for r in part[self.columns].astype(object).itertuples(index=False)]
        self.waiting.appendList(came)
        self.handle.registerTimer(-(-min(int(r[0]) for r in came) // 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        *now, last = self.held.get() if self.held.exists() else (*self.empty, 0)
        now, out = tuple(now), []
        for row in ready:
            now, found = self.step(key[0], now, row)
            out.append(found)
            last = int(row[0])
        if later:
            self.waiting.put([tuple(plain(r)) for r in later])
            self.handle.registerTimer(-(-later[0][0] // 1000))
        else:
            self.waiting.clear()
        if ready:
            self.held.update((*plain(now), last))
            self.handle.registerTimer(-(-(last + self.keep_us) // 1000) + 1)
        elif not later and passed > last + self.keep_us:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, fields: str, out: str, state: str, empty: tuple, step: Callable, keep_s: int) -> DataFrame:
    """rows: key, ts (with a watermark), and fields, of which the first two are ts_us and event_id."""
    names = lambda ddl: T.StructType.fromDDL(ddl).names
    processor = InOrder(fields, state, names(fields), names(out), empty, step, keep_s)
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """How many rows a stream has dropped since they came after the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def rate_limit(stream: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S, watermark: str = WATERMARK) -> DataFrame:
    """Hits (visitor, event_id, ts) with accepted and remaining, as rate_limit_batch has them."""

    def step(visitor, state, row):
        hits, [(event, ts, ok, left)] = take_hits(list(state[0]), [(int(row[0]), int(row[1]))], limit, window_s)
        return (hits,), (visitor, event, ts, ok, left)

    rows = stream.select("visitor", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark).withColumn("ts_us", F.unix_micros("ts"))
    return in_order(rows, "visitor", "ts_us long, event_id long", HIT_FIELDS, "hits array<long>", ([],), step, window_s)


CHAT_ROW = "ts_us long, event_id long, action string, plan string, ranked array<long>"
CHAT_STATE = "hits array<long>, start long, turn long, since long, plan string, ranked array<long>, cursor long"


def chat(messages: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S, questions: int = QUESTIONS, idle_s: int = IDLE_S, watermark: str = WATERMARK) -> DataFrame:
    """Messages (visitor, event_id, ts, action, plan, ranked) with status, turn and page, as chat_batch has them."""

    def step(visitor, state, row):
        ts, event, action, plan, ranked = row
        now, found = chat_turn(state, int(ts), action, plan, [int(x) for x in ranked], limit, window_s, questions, idle_s)
        hits, start, turn, last, held, ids, cursor = now
        return ([int(h) for h in hits], start, turn, last, held, [int(i) for i in ids], cursor), (visitor, int(event), int(ts), *found)

    rows = messages.select("visitor", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action", "plan", F.coalesce("ranked", F.array().cast("array<long>")).alias("ranked"))
    rows = rows.withWatermark("ts", watermark).withColumn("ts_us", F.unix_micros("ts"))
    return in_order(rows, "visitor", CHAT_ROW, CHAT_FIELDS, CHAT_STATE, EMPTY, step, max(idle_s, window_s))


def daily_cap(calls: DataFrame, cap: int, timezone: str = "UTC", watermark: str = WATERMARK) -> DataFrame:
    """Calls (event_id, ts) with local_day and allowed, as the batch daily_cap has them."""

    def step(day, state, row):
        return (min(cap, int(state[0]) + 1),), (int(row[1]), day, int(state[0]) < cap)

    rows = calls.select("event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    rows = rows.withColumns({"ts_us": F.unix_micros("ts"), "local_day": local_day(F.col("ts"), timezone).cast("string")})
    return in_order(rows, "local_day", "ts_us long, event_id long", "event_id long, local_day string, allowed boolean", "spent long", (0,), step, 2 * 86_400)
