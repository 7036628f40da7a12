"""Weekly opening hours: text to intervals, and whether a place is open at an instant.

Parsing runs on the distinct texts only and as column expressions. Behaviours kept on purpose: text without a day part
closes every day; the day part ends at the first colon; a start without AM/PM takes the end's; all-day is 00:00 to
23:59:00; ends are inclusive but for the part after midnight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL_DAY = r"\b24\s*(h\b|hours?\b|horas?\b)|\b24/7\b"
GARBAGE = ("dtype: object", "Name: openingHours")
# Day names by position in the week, with the Portuguese names of whole words.
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
DAYS_PT = {"segunda": 0, "terça": 1, "terca": 1, "quarta": 2, "quinta": 3, "sexta": 4, "sábado": 5, "sabado": 5, "domingo": 6}
TIME = r"(\d{1,2})(?::(\d{2}))?\s*(am|pm)?"


def _day(col: Column) -> Column:
    """0 for Monday to 6 for Sunday, or null: three first letters in English, the whole word in Portuguese."""
    word = F.lower(F.trim(col))
    out = F.lit(None).cast("int")
    for name, i in DAYS_PT.items():
        out = F.when(word == name, i).otherwise(out)
    for i, name in enumerate(DAYS):
        out = F.when(word.startswith(name), i).otherwise(out)
    return out


def _days(part: Column) -> Column:
    part = F.translate(part, "–", "-")
    ends = F.split(part, "-")
    a, b = _day(F.get(ends, F.lit(0))), _day(F.get(ends, F.lit(1)))
    span = F.transform(F.sequence(F.lit(0), F.pmod(b - a, F.lit(7))), lambda k: F.pmod(a + k, F.lit(7)))
    listed = F.filter(F.transform(F.split(part, ","), _day), lambda d: d.isNotNull())
    return F.when(F.contains(part, F.lit("-")), F.when((F.size(ends) == 2) & a.isNotNull() & b.isNotNull(), span)).otherwise(listed)


def _microseconds(text: Column, half: Column) -> Column:
    """One time, with the half of the day that holds for it; null when there is no such time."""
    hour = F.regexp_extract(text, r"(?i)" + TIME, 1).try_cast("int")
    minute = F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)" + TIME, 2), F.lit("")).try_cast("int"), F.lit(0))
    hour = F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    return F.when(minute < 60, (F.pmod(hour, F.lit(24)) * 3600 + minute * 60).cast("long"))


def _ranges(part: Column) -> Column:
    """Intervals (seconds of the day) of one day's text."""

    def one(text: Column) -> Column:
        times = F.regexp_extract_all(text, F.lit(r"(?i)(\d{1,2}(?::\d{2})?\s*(?:am|pm)?)"), F.lit(1))
        first, second = F.get(times, F.lit(0)), F.get(times, F.lit(1))
        half = lambda t: F.nullif(F.upper(F.regexp_extract(t, r"(?i)" + TIME, 3)), F.lit(""))
        return F.struct(_microseconds(first, F.coalesce(half(first), half(second))).alias("start"), _microseconds(second, half(second)).alias("end"))

    found = F.filter(F.transform(F.split(part, ","), one), lambda r: r["start"].isNotNull() & r["end"].isNotNull())
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(23 * 3600 + 59 * 60).cast("long").alias("end")))
    return F.when(F.lower(part).contains("closed"), F.slice(found, 1, 0)).when(F.lower(F.trim(part)).rlike(ALL_DAY), whole).otherwise(found)


def parse_hours(texts: DataFrame, col: str = "hours_raw") -> DataFrame:
    """(hours_raw, day, start_s, end_s) of the distinct texts in the column; later parts for a day replace earlier ones."""
    raw = F.col(col)
    distinct = texts.select(col).where(F.trim(raw) != "").distinct()
    lower = F.lower(F.trim(raw))
    always = ~F.contains(raw, F.lit(":")) & lower.rlike(ALL_DAY)
    # the object form is a list of day: times entries under quotes
    entries = F.when(
        lower.rlike(r"^\{.*\}$"), F.regexp_extract_all(raw, F.lit(r'("[^"]*"\s*:\s*"[^"]*")'), F.lit(1))
    ).otherwise(F.split(raw, ";"))
    parts = F.when(always, F.array(F.lit("Monday-Sunday: 24 hours"))).otherwise(F.transform(entries, lambda p: F.translate(p, '"', "")))
    days = distinct.select(col, F.posexplode(parts).alias("part", "text")).where(F.contains("text", F.lit(":")))
    cut = F.instr("text", ":")
    days = days.select(col, "part", F.explode(_days(F.trim(F.substring(F.col("text"), F.lit(1), cut - 1)))).alias("day"), _ranges(F.trim(F.substring(F.col("text"), cut + 1, F.length("text")))).alias("ranges"))
    last = days.groupBy(col, "day").agg(F.max_by("ranges", "part").alias("ranges"))
    return last.select(col, "day", F.explode("ranges").alias("r")).select(col, "day", F.col("r.start").alias("start_s"), F.col("r.end").alias("end_s"))


def hours_outcome(texts: DataFrame, intervals: DataFrame, col: str = "hours_raw") -> DataFrame:
    """The rows with hours_clean and hours_status: garbage (a serialised table), unknown (nothing to read) or parsed."""
    garbage = F.lit(False)
    for marker in GARBAGE:
        garbage = garbage | F.coalesce(F.contains(F.col(col), F.lit(marker)), F.lit(False))
    clean = F.when(~garbage, F.nullif(F.trim(F.replace(F.col(col), F.lit(" "), F.lit(" "))), F.lit("")))
    read = intervals.select(F.col(col).alias("hours_clean")).distinct().withColumn("__read", F.lit(True))
    out = texts.withColumns({"hours_clean": clean, "__garbage": garbage}).join(read.hint("merge"), "hours_clean", "left")
    status = F.when(F.col("__garbage"), "garbage").when(F.col("__read"), "parsed").otherwise("unknown")
    return out.withColumn("hours_status", status).drop("__garbage", "__read")


# Day names of the JSON form.
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def hours_json(texts: DataFrame, intervals: DataFrame, col: str = "hours_raw") -> DataFrame:
    """(hours_raw, hours_json) of the distinct texts: each day that has intervals with its ranges as HH:MM:SS in order of start."""
    clock = lambda c: F.date_format(F.timestamp_seconds(F.col(c)), "HH:mm:ss")
    ranges = intervals.groupBy(col, "day").agg(F.array_sort(F.collect_list(F.struct(clock("start_s").alias("start"), clock("end_s").alias("end")))).alias("ranges"))
    day = F.struct(F.col("day"), F.element_at(F.array(*map(F.lit, DAY_NAMES)), F.col("day") + 1).alias("name"), F.struct(F.lit(False).alias("is_closed"), "ranges").alias("of"))
    weeks = ranges.groupBy(col).agg(F.transform(F.array_sort(F.collect_list(day)), lambda d: F.struct(d["name"].alias("key"), d["of"].alias("value"))).alias("days"))
    out = texts.select(col).where(F.col(col).isNotNull()).distinct().join(weeks.hint("merge"), col, "left")
    return out.select(col, F.when(F.col("days").isNotNull(), F.to_json(F.map_from_entries("days"))).alias("hours_json"))


def with_week(rows: DataFrame, intervals: DataFrame, col: str = "hours_raw") -> DataFrame:
    """The rows with `week`, all intervals (day, start_s, end_s) of their text; null where there is none. A text bounds its own list."""
    weeks = intervals.groupBy(col).agg(F.collect_list(F.struct("day", "start_s", "end_s")).alias("week"))
    return rows.join(weeks.hint("merge"), col, "left")


def is_open(week: Column, day: Column, second: Column) -> Column:
    """Whether a week's intervals hold an instant: in an interval of that day, or in the tail of one that began the day before and runs over midnight."""

    def holds(i: Column) -> Column:
        over = i["end_s"] < i["start_s"]
        today = (i["day"] == day) & F.when(over, second >= i["start_s"]).otherwise(second.between(i["start_s"], i["end_s"]))
        return today | (over & (i["day"] == F.pmod(day + 6, F.lit(7))) & (second < i["end_s"]))

    return F.coalesce(F.exists(week, holds), F.lit(False))


def instant_slots(instants: DataFrame, intervals: DataFrame) -> DataFrame:
    """(day_idx, sec_of_day, slot) of the distinct instants, with slots numbered from 0: within a slot, a stretch of a day between the times at which any
    text opens or closes, the same texts are open. A day has no more rows than seconds, whatever the input."""
    closing = lambda c: [F.col(c), F.col(c) + 1]  # noqa: E731  # an end is open itself, but for a tail
    times = intervals.select("day", F.explode(F.array("start_s", *closing("end_s"))).alias("sec")).distinct()
    turns = times.unionByName(times.withColumn("day", F.pmod(F.col("day") + 1, F.lit(7)))).distinct().select("day", F.col("sec").cast("long").alias("sec"), F.lit(1).alias("turn"))
    asked = instants.select(F.col("day_idx").alias("day"), F.col("sec_of_day").cast("long").alias("sec"), F.lit(0).alias("turn")).where("day is not null and sec is not null").distinct()
    stretches = asked.unionByName(turns).withColumn("stretch", F.sum("turn").over(Window.partitionBy("day").orderBy("sec", F.desc("turn")))).where("turn = 0")
    return stretches.select(F.col("day").alias("day_idx"), F.col("sec").alias("sec_of_day"), (F.dense_rank().over(Window.orderBy("day", "stretch")) - 1).alias("slot"))


def slot_instants(slots: DataFrame) -> list[tuple[int, int]]:
    """An instant of each slot, by its number: no more than a week has seconds."""
    return [tuple(r.at) for r in slots.groupBy("slot").agg(F.min(F.struct("day_idx", "sec_of_day")).alias("at")).orderBy("slot").collect()]


def with_open_slots(rows: DataFrame, intervals: DataFrame, instants: list[tuple[int, int]], col: str = "hours_raw") -> DataFrame:
    """The rows with `open_slots`: 64 slots a number, a bit set where their text is open; null where it has no intervals. Worked out once for each text."""
    days, seconds = (np.array([x[i] for x in instants], np.int64) for i in range(2))

    @F.pandas_udf("array<long>")
    def bits(weeks: pd.Series) -> pd.Series:
        def of(week: np.ndarray) -> list[int]:
            day, start, end = (week[:, None] >> s & (1 << 20) - 1 for s in (40, 20, 0))
            over = end < start
            today = (day == days) & (seconds >= start) & (over | (seconds <= end))
            held = (today | over & (day == (days + 6) % 7) & (seconds < end)).any(axis=0)
            return np.packbits(np.r_[held, np.zeros(-len(held) % 64, bool)], bitorder="little").view("<i8").tolist()

        return weeks.map(lambda w: of(np.asarray(w, np.int64)))

    packed = F.shiftleft(F.col("day").cast("long"), 40) + F.shiftleft(F.col("start_s").cast("long"), 20) + F.col("end_s")
    weeks = intervals.groupBy(col).agg(F.collect_list(packed).alias("__week"))
    return rows.join(weeks.select(col, bits("__week").alias("open_slots")).hint("merge"), col, "left")


def open_in(open_slots: Column, slot: Column) -> Column:
    return F.coalesce(F.getbit(F.get(open_slots, F.floor(slot / 64).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1, F.lit(False))
