"""Conversations and fair use in batch: sessions, turns, inherited slots and daily caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE_S, QUESTIONS = 1800, 4


def local_day(ts: Column, timezone: str) -> Column:
    """The city's calendar day at a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), timezone))


def local_clock(ts: Column, timezone: str) -> tuple[Column, Column]:
    """Day of the week (0 Monday) and second of the day of the city at a UTC instant."""
    at = F.from_utc_timestamp(ts.cast("timestamp"), timezone)
    return F.weekday(at), (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("long")


def sessionize(events: DataFrame, key: str = "visitor", ts: str = "ts", order: str = "event_id", idle_s: int = IDLE_S) -> DataFrame:
    """Adds session_no: a visitor's next session begins when more than idle_s have passed since the event before."""
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    new = F.when(gap > idle_s * 1_000_000, 1).otherwise(0)
    return events.withColumn("__new", new).withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def merge_turns(turns: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("ts", "turn_key"), category: str = "category", slots: tuple[str, ...] = ("open_now", "min_rating")) -> DataFrame:
    """Slots as a follow-up inherits them: a turn with a category starts afresh, another keeps the last set value of what it leaves unset: null, false or an empty list."""
    types = dict(turns.dtypes)
    is_set = lambda c: F.coalesce(F.col(c), F.lit(False)) if types[c] == "boolean" else F.coalesce(F.size(c) > 0, F.lit(False)) if types[c].startswith("array") else F.col(c).isNotNull()
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = turns.withColumn("__run", F.sum(is_set(category).cast("long")).over(w))
    inside = Window.partitionBy(key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c: F.last(F.when(is_set(c), F.col(c)), ignorenulls=True).over(inside) for c in (category, *slots)}).drop("__run")


def turn_budget(turns: DataFrame, key: tuple[str, ...], order: tuple[str, ...], question: Column, limit: int = QUESTIONS) -> DataFrame:
    """Adds allowed: the first `limit` questions of a conversation; other turns are free."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("allowed", ~question | (F.sum(question.cast("long")).over(w) <= limit))


def daily_cap(calls: DataFrame, cap: int, timezone: str = "UTC", ts: str = "ts", order: str = "event_id", counts: Column | None = None) -> DataFrame:
    """Adds local_day and allowed: the first `cap` calls of each city day; rows where `counts` is false spend nothing and aren't called."""
    counts = F.lit(True) if counts is None else counts
    rows = calls.withColumn("local_day", local_day(F.col(ts), timezone)).withColumn("__counts", counts)
    # calls at or before a day's cap-th instant are found by a top-k per day and hour first, so that no task sorts a whole day
    hour = Window.partitionBy("local_day", F.date_trunc("hour", F.col(ts).cast("timestamp"))).orderBy(ts, order)
    early = rows.where("__counts").withColumn("__k", F.row_number().over(hour)).where(F.col("__k") <= cap)
    day = Window.partitionBy("local_day").orderBy(ts, order)
    taken = early.withColumn("__n", F.row_number().over(day)).where(F.col("__n") <= cap).select(F.col(order).alias("__taken"))
    return rows.join(taken.hint("shuffle_hash"), F.col(order) == F.col("__taken"), "left").withColumn("allowed", F.col("__taken").isNotNull()).drop("__taken", "__counts")
