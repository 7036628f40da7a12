"""Exact dedup by progressive refinement: length, then a hash of the first characters, then a hash of the whole text.

Texts are equal when they are identical after each run of [\\x20\\x09-\\x0D] is replaced by one space; null counts as
empty. Of equal texts the row with the smallest id stays. One pass over the texts takes each row's length, prefix hash and
digest, for a length after folding blanks needs the whole text anyway; they are written once, some 60 bytes a row. Groups are then refined on
these narrow rows: only rows whose length is shared go on to the prefix hash, and only rows whose (length, prefix hash) is shared
have their digests compared. The texts themselves are never shuffled. Every step is a grouped count with map-side
combine, and a join back deals the rows of a key among tasks, so a group with a third of all rows is no single task's.

`drop_copies` keeps whole rows and needs no digest of every text: one pass takes lengths and prefix hashes, and only rows that share both with
another are digested. All others stay where they are, told by a bit map of fixed size; of those digested one row a text and map task moves.

Defined cases: a null text equals an empty one, and a text of blanks only equals a single space. Repeated rows count
one by one; of rows that repeat the smallest id, all say kept, while drop_copies keeps one of them. A null id never survives beside a real one. Very long
texts are read whole. An empty table gives an empty result. Columns not asked for in `carry` are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import BLANKS, dealt_join, first_rows, sifted, written

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def measured(df: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = (), prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """__id, the carried columns as one struct, and the length, prefix hash and digest of the normalised text."""
    norm = F.col("__norm")
    rows = df.select(df[id_col].alias("__id"), F.struct(*[df[c] for c in carry]).alias("__carry") if carry else F.lit(0).alias("__carry"), normalised(df[text_col]).alias("__norm"))
    return rows.select("__id", "__carry", F.octet_length(norm).alias("__len"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("__pre"), F.unhex(F.sha2(norm, 256)).alias("__sha"))


def groups(rows: DataFrame) -> DataFrame:
    """(length, prefix hash, digest) that several measured rows share, with the smallest id and the number of rows: each step looks at what the one before left."""

    def shared(part: DataFrame, *keys: str) -> DataFrame:
        return part.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__keep")).where("__size > 1")

    spread = F.xxhash64("__id", "__sha")
    by_length = dealt_join(rows, shared(rows, "__len").select("__len"), ["__len"], "left_semi", spread)
    by_prefix = dealt_join(by_length, shared(by_length, "__len", "__pre").select("__len", "__pre"), ["__len", "__pre"], "left_semi", spread)
    return shared(by_prefix, "__len", "__pre", "__sha")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """id, the carried columns, keep_id, group_size, kept and text_sha256 (of the normalised text), one row for each row of df."""
    rows = written(measured(df, id_col, text_col, carry, prefix_chars), "measured")
    out = dealt_join(rows, groups(rows), ["__len", "__pre", "__sha"], "left", F.xxhash64("__id"))
    keep = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return out.select(
        F.col("__id").alias(id_col),
        *[F.col("__carry").getField(c).alias(c) for c in carry],
        keep.alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("__id").eqNullSafe(keep), F.lit(False)).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One whole row of df for each different text: the one with the smallest id. Only rows whose length and prefix hash others share are digested."""
    norm = normalised(df[text_col])
    length, prefix = F.octet_length(norm), F.xxhash64(F.substring(norm, 1, prefix_chars))
    rows = written(df.select(length.alias("__len"), prefix.alias("__pre")), "measured")
    shared = lambda part, *keys: part.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where("__size > 1").select(*keys)
    by_length = dealt_join(rows, shared(rows, "__len"), ["__len"], "left_semi", F.col("__pre"))
    keys = shared(by_length, "__len", "__pre").select(F.xxhash64("__len", "__pre").alias("key"))
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), df[id_col].alias("__id"), df[text_col].alias("__text"), F.xxhash64(length, prefix).alias("__key"))
    marked = sifted(whole, F.col("__key"), keys)
    digested = marked.where("__held").select("__row", "__id", F.unhex(F.sha2(normalised(F.col("__text")), 256)).alias("__sha"))
    kept = marked.where("not __held").select("__row").unionByName(first_rows(digested, "__sha", "__id").select("__row"))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in df.columns])


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
