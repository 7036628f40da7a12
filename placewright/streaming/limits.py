"""Streams of visitor hits and messages with state: sliding limits, conversations with their last results, daily caps; and their batch twins.

Late rows: a watermark of ten minutes on event time; rows within a micro-batch are taken in order of (ts, event_id). State of a
visitor is at most `limit` instants, a conversation's three numbers, its last plan and at most KEPT ranked ids; all state is removed when it expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placewright.operators.conversations import IDLE_S, QUESTIONS, local_day, sessionize
from placewright.operators.search import KEPT, SHOWN

LIMIT, WINDOW_S = 20, 600
WATERMARK = "10 minutes"
HIT_FIELDS = "visitor long, event_id long, ts_us long, accepted boolean, remaining int"


def take_hits(hits: list[int], rows: list[tuple[int, int]], limit: int, window_s: int) -> tuple[list[int], list[tuple[int, int, bool, int]]]:
    """Accepts rows (ts_us, event_id) in order while fewer than `limit` accepted hits lie within the window; one exactly window_s old has expired."""
    out = []
    for ts, event in sorted(rows):
        hits = [t for t in hits if t > ts - window_s * 1_000_000]
        ok = len(hits) < limit
        if ok:
            hits.append(ts)
        out.append((event, ts, ok, limit - len(hits)))
    return hits, out


def _hits(events: DataFrame) -> DataFrame:
    return events.select("visitor", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("ts_us", F.unix_micros("ts"))


def rate_limit(stream: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """Streaming: each hit with accepted and remaining. A denied hit leaves no trace in the state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [r for part in parts for r in zip(part["ts_us"], part["event_id"])]
        hits, out = take_hits(list(state.get[0]) if state.exists else [], rows, limit, window_s)
        state.update((hits,))
        state.setTimeoutTimestamp(max(max(ts for ts, _ in rows) // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], e, ts, ok, left) for e, ts, ok, left in out], columns=["visitor", "event_id", "ts_us", "accepted", "remaining"])

    marked = _hits(stream).withWatermark("ts", WATERMARK)
    return marked.groupBy("visitor").applyInPandasWithState(run, HIT_FIELDS, "hits array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_batch(events: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """The same over a table: each visitor's hits are read once in order of time, holding `limit` instants."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        visitor, hits = None, []
        for part in parts:
            rows = []
            for v, e, ts in zip(part["visitor"], part["event_id"], part["ts_us"]):
                if v != visitor:
                    visitor, hits = v, []
                hits, out = take_hits(hits, [(ts, e)], limit, window_s)
                rows += [(v, *o) for o in out]
            yield pd.DataFrame(rows, columns=["visitor", "event_id", "ts_us", "accepted", "remaining"])

    dealt = _hits(events).select("visitor", "event_id", "ts_us").repartition("visitor").sortWithinPartitions("visitor", "ts_us", "event_id")
    return dealt.mapInPandas(run, HIT_FIELDS)


TURN_FIELDS = "visitor long, event_id long, ts_us long, session_start long, turn long, allowed boolean"


def conversations(accepted: DataFrame, questions: int = QUESTIONS, idle_s: int = IDLE_S) -> DataFrame:
    """Streaming: accepted hits as turns of conversations, each known by the instant it began. One idle for more than idle_s ends, and its state goes;
    its first `questions` turns are answered."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, turn, last = state.get if state.exists else (None, 0, None)
        out = []
        for ts, event in sorted((ts, e) for part in parts for ts, e in zip(part["ts_us"], part["event_id"])):
            if last is None or ts - last > idle_s * 1_000_000:
                start, turn = ts, 0
            turn, last = turn + 1, ts
            out.append((key[0], event, ts, start, turn, turn <= questions))
        state.update((int(start), int(turn), int(last)))
        state.setTimeoutTimestamp(max(last // 1000 + idle_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=TURN_COLUMNS)

    return accepted.groupBy("visitor").applyInPandasWithState(run, TURN_FIELDS, "start long, turn long, last long", "append", GroupStateTimeout.EventTimeTimeout)


TURN_COLUMNS = [x.split()[0] for x in TURN_FIELDS.split(", ")]
CHAT_FIELDS = "visitor long, event_id long, ts_us long, status string, session_start long, turn long, remaining int, plan string, page array<long>, has_more boolean"
CHAT_STATE = "hits array<long>, start long, turn long, last long, plan string, ranked array<long>, cursor long"
ASKED = ["visitor", "event_id", "ts_us", "action", "plan", "ranked"]
EMPTY = ([], None, 0, None, None, [], 0)


def chat_turn(state: tuple, ts: int, action: str | None, plan: str | None, ranked: list[int], limit: int, window_s: int, questions: int, idle_s: int) -> tuple[tuple, tuple]:
    """The state after one message, and (status, session_start, turn, remaining, plan, page, has_more).

    A hit over the limit is `denied` and leaves no trace. `more` gives the next page of the conversation's last list and spends no turn (`page`, or `no_results`
    without a list); another message is a question: it spends a turn and is `answered`, or `finished` when no turn is left."""
    hits, start, turn, last, held, ids, cursor = state
    hits, [(_, _, accepted, remaining)] = take_hits(list(hits), [(ts, 0)], limit, window_s)
    if not accepted:
        return (hits, start, turn, last, held, ids, cursor), ("denied", start, turn, remaining, None, [], False)
    if last is None or ts - last > idle_s * 1_000_000:
        start, turn, held, ids, cursor = ts, 0, None, [], 0
    last, page = ts, []
    if action == "more":
        status = "page" if len(ids) else "no_results"
        page = list(ids[cursor : cursor + SHOWN])
        cursor += len(page)
    elif turn >= questions:
        status = "finished"
    else:
        status, turn, held, ids = "answered", turn + 1, plan, list(ranked)[:KEPT]
        page = ids[:SHOWN]
        cursor = len(page)
    answered = status in ("page", "answered")
    return (hits, start, turn, last, held, ids, cursor), (status, start, turn, remaining, held if answered else None, page, answered and cursor < len(ids))


def _asked(messages: DataFrame) -> DataFrame:
    return messages.select("visitor", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action", "plan", F.coalesce("ranked", F.array().cast("array<long>")).alias("ranked")).withColumn("ts_us", F.unix_micros("ts"))


def _rows(part: pd.DataFrame) -> Iterator[tuple]:
    text = lambda x: x if isinstance(x, str) else None
    for v, e, ts, action, plan, ranked in part[ASKED].itertuples(index=False):
        yield v, e, ts, text(action), text(plan), [int(x) for x in ranked]


def chat_stream(messages: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S, questions: int = QUESTIONS, idle_s: int = IDLE_S) -> DataFrame:
    """Streaming: messages (visitor, event_id, ts, action, plan, ranked ids of its answer) in; status, conversation, turn and a page of ids out.

    The limit comes first and only accepted messages touch the conversation, in one operator with one state a visitor."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, out = state.get if state.exists else EMPTY, []
        for v, e, ts, action, plan, ranked in sorted((r for part in parts for r in _rows(part)), key=lambda r: (r[2], r[1])):
            now, found = chat_turn(now, ts, action, plan, ranked, limit, window_s, questions, idle_s)
            out.append((v, e, ts, *found))
        hits, start, turn, last, plan, ids, cursor = now
        state.update(([int(h) for h in hits], start and int(start), int(turn), last and int(last), plan, [int(i) for i in ids], int(cursor)))
        state.setTimeoutTimestamp(max(out[-1][2] // 1000 + 1000 * max(idle_s, window_s) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=CHAT_COLUMNS)

    return _asked(messages).withWatermark("ts", WATERMARK).groupBy("visitor").applyInPandasWithState(run, CHAT_FIELDS, CHAT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


CHAT_COLUMNS = [x.split()[0] for x in CHAT_FIELDS.split(", ")]


def chat_batch(messages: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S, questions: int = QUESTIONS, idle_s: int = IDLE_S) -> DataFrame:
    """The same over a table: each visitor's messages are read once in order of time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        visitor, now = None, EMPTY
        for part in parts:
            out = []
            for v, e, ts, action, plan, ranked in _rows(part):
                if v != visitor:
                    visitor, now = v, EMPTY
                now, found = chat_turn(now, ts, action, plan, ranked, limit, window_s, questions, idle_s)
                out.append((v, e, ts, *found))
            yield pd.DataFrame(out, columns=CHAT_COLUMNS)

    return _asked(messages).select(*ASKED).repartition("visitor").sortWithinPartitions("visitor", "ts_us", "event_id").mapInPandas(run, CHAT_FIELDS)


def daily_cap_stream(calls: DataFrame, cap: int, timezone: str = "UTC") -> DataFrame:
    """Streaming: calls (event_id, ts) with local_day and allowed, the first `cap` of each of the city's days as they come. A day's state is one number, which goes a day after it."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (spent,), out = state.get if state.exists else (0,), []
        for ts, event in sorted((ts, e) for part in parts for ts, e in zip(part["ts_us"], part["event_id"])):
            out.append((event, key[0], spent < cap))
            spent = min(cap, spent + 1)
        state.update((int(spent),))
        state.setTimeoutTimestamp(max(ts // 1000 + 2 * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "local_day", "allowed"])

    rows = calls.select("event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", WATERMARK)
    rows = rows.withColumns({"ts_us": F.unix_micros("ts"), "local_day": local_day(F.col("ts"), timezone).cast("string")})
    return rows.groupBy("local_day").applyInPandasWithState(run, "event_id long, local_day string, allowed boolean", "spent long", "append", GroupStateTimeout.EventTimeTimeout)


def hits_to_turns(events: DataFrame, limit: int = LIMIT, window_s: int = WINDOW_S, questions: int = QUESTIONS, idle_s: int = IDLE_S) -> DataFrame:
    """Batch: the rate limit first, then turns of the accepted hits; a denied message spends no turn."""
    ok = rate_limit_batch(events, limit, window_s).where("accepted").withColumn("ts", F.timestamp_micros("ts_us"))
    of = Window.partitionBy("visitor", "session_no")
    turns = sessionize(ok, idle_s=idle_s).withColumns({"session_start": F.min("ts_us").over(of), "turn": F.row_number().over(of.orderBy("ts_us", "event_id")).cast("long")})
    return turns.select("visitor", "event_id", "ts_us", "session_start", "turn", (F.col("turn") <= questions).alias("allowed"))


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that the stream holds now, as a table in memory (for tests and small checks)."""
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
