"""What the corpus operators share: written intermediate tables, deterministic samples, and sieves for rows that need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.tables import shared_folder, written  # noqa: F401

#: One run of ASCII white space, as the contracts define it.
BLANKS = r"[\x20\x09-\x0D]+"


def crc_of_id(col: Column) -> Column:
    """crc32 of the id written as text (null for a null id)."""
    return F.crc32(col.cast("string").cast("binary"))


def id_share(col: Column, salt: int = 0) -> Column:
    """A number in [0, 1) that only the id decides: keep rows below a share to draw a repeatable sample without a shuffle."""
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def groups_for(rows: int, each: int, least: int = 1) -> int:
    """How many groups keep about `each` rows a group at any size of input."""
    return max(least, -(-rows // each))


#: Bits of a sieve: at most 2^20 words of 64, some 25 MB as a broadcast table.
SIEVE_BITS = 1 << 26


def sifted(rows: DataFrame, by: Column, keys: DataFrame, key: str = "key") -> DataFrame:
    """rows with __held: true where the 64-bit key `by` is in the table of keys, false for nearly all others.

    A bit map whose size is fixed, so its broadcast is bounded however many keys there are. With more keys it holds more others; it only
    decides which rows have to move to be compared, never a result."""
    bit = lambda c: c.bitwiseAND(SIEVE_BITS - 1)
    place = lambda c: bit(c).bitwiseAND(63).cast("int")
    words = keys.select(F.shiftright(bit(F.col(key)), 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col(key))).alias("bits"))
    words = written(words.groupBy("__word").agg(F.bit_or("bits").alias("__bits")), "sieve")
    marked = rows.withColumns({"__word": F.shiftright(bit(by), 6), "__place": place(by)}).join(F.broadcast(words), "__word", "left")
    return marked.withColumn("__held", F.coalesce(F.getbit("__bits", F.col("__place")) == 1, F.lit(False))).drop("__word", "__place", "__bits")


#: Copies of a small table's rows, and parts that a hot key's rows are dealt to.
SALTS = 16


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], how: str, by: Column) -> DataFrame:
    """rows joined with a table of distinct keys. The table goes to SALTS tasks a key and the rows of a hot key are dealt among them by the hash `by`."""
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(by, F.lit(SALTS)).cast("int")).join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def first_rows(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """One whole row for each key: that with the smallest id (null last; of rows with that id, one that their values decide). Each map task sends on one a key."""
    columns = [c for c in rows.columns if c != key]
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*columns))
    one = rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("__row"))
    return one.select(key, *[F.col("__row").getField(c).alias(c) for c in columns])
