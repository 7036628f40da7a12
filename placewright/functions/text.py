"""Text columns: trimming, folding, parsing, re-casing and name similarity."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters with marks and the letters under them.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"

NAME_RULES = (
    # Replacements in the order in which they apply.
    ("restaurante", "rest"), ("lanchonete", "lanch"), ("padaria", "pad"), ("supermercado", "sup"), ("açaí", "acai"), ("são", "sao"),
    ("nossa senhora", "n s"), ("nª sª", "n s"), ("av.", "avenida"), ("r.", "rua"), ("tv.", "travessa"),
)


def trim_blanks(col: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def clean_str(col: Column) -> Column:
    return F.nullif(trim_blanks(col), F.lit(""))


def clean_num(col: Column) -> Column:
    return trim_blanks(col).try_cast("double")


def clean_int(col: Column, default: int | None = 0) -> Column:
    """Whole part of a number; the default where there is none."""
    whole = F.when(F.isnan(clean_num(col)), None).otherwise(clean_num(col)).try_cast("bigint")
    return F.coalesce(whole, F.lit(default)) if default is not None else whole


def clean_bool(col: Column) -> Column:
    return F.coalesce(F.upper(trim_blanks(col)).isin("TRUE", "1", "YES", "SIM"), F.lit(False))


def fold(col: Column, spaces: bool = False, underscores: bool = False) -> Column:
    """Lower case without marks or outer blanks; underscores as spaces and runs of blanks as one space if asked."""
    out = F.translate(col, MARKED, PLAIN)
    out = F.translate(out, "_", " ") if underscores else out
    out = F.lower(F.trim(out))
    return F.regexp_replace(out, r"\s+", " ") if spaces else out


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def recase_title(col: Column, exceptions: tuple[str, ...]) -> Column:
    """Title case for a title in small letters, or in capitals with several words; exception words stay small but for the first."""
    small = (col == F.lower(col)) & (col != F.upper(col))
    capitals = (col == F.upper(col)) & (col != F.lower(col)) & (F.size(F.split(F.trim(col), r"\s+")) > 1)
    words = F.transform(
        F.split(F.lower(col), " "),
        lambda w, i: F.when((i > 0) & w.isin(*exceptions), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
    )
    return F.when(small | capitals, F.array_join(words, " ")).otherwise(col)


def normalize_name(col: Column) -> Column:
    out = F.trim(F.lower(F.coalesce(col, F.lit(""))))
    for old, new in NAME_RULES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def garbled(col: Column) -> Column:
    return F.contains(col, F.lit("?")) | F.contains(col, F.lit("�"))


def letter_bits(a: str) -> dict[str, int]:
    """For each character of a, where it stands, as bits of an integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def common_length(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, one bit of an integer for each character of a; at: a's letter_bits, if they are there."""
    at = letter_bits(a) if at is None else at
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2 * common_length(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against the windows of its length in the longer, those cut off at the ends included."""
    short, long_ = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 1.0 if not long_ else 0.0
    windows, at = {long_[max(0, i) : i + n] for i in range(1 - n, len(long_))}, letter_bits(short)
    return max(2 * common_length(short, w, at) / (n + len(w)) for w in windows)


@lru_cache(maxsize=100_000)
def name_score(a: str, b: str) -> float:
    """0.3 whole + 0.3 best window + 0.4 sorted words, of normalised names."""
    if not a or not b:
        return 0.0
    return 0.3 * indel_ratio(a, b) + 0.3 * partial_ratio(a, b) + 0.4 * indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_score(x or "", y or "") for x, y in zip(a, b)])


def name_letters(a: str | None) -> dict | None:
    """What bounds name_score without the letters' order: n characters, and the first, second, … of each character as 128 bits; none where blanks are not
    single ones, as sorted words then have fewer characters than the name."""
    if not a or a != " ".join(a.split()):
        return None
    seen: dict[str, int] = {}
    bits = [0, 0]
    for c in a:
        seen[c] = seen.get(c, 0) + 1
        at = (ord(c) * 37 + (seen[c] - 1) * 61) % 126  # 63 bits of each number, so that none is negative
        bits[at // 63] |= 1 << at % 63
    return {"n": len(a), "low": bits[0], "high": bits[1]}


@F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
def name_bounds(names: pd.Series) -> pd.DataFrame:
    found = [name_letters(a) or {} for a in names]
    return pd.DataFrame({k: pd.array([x.get(k) for x in found], dtype="Int64") for k in ("n", "low", "high")})


def most_similarity(a: Column, b: Column) -> Column:
    """At least the name_score of two names with the name_bounds a and b. A bit that only one name has is a character that has no partner in the other; with m
    characters that may have one, no ratio of whole names exceeds that of m in common, and no window is better than one of those m."""
    alone = lambda x, y: sum(F.bit_count(x[half].bitwiseAND(F.bitwise_not(y[half]))) for half in ("low", "high"))
    m = F.least(a["n"] - alone(a, b), b["n"] - alone(b, a))
    return F.coalesce(0.7 * 2 * m / (a["n"] + b["n"]) + 0.3 * 2 * m / (F.least(a["n"], b["n"]) + m), F.lit(1.0))


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, longest first."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() if x and y else 0.0 for x, y in zip(a, b)])


def visitor_ip(forwarded: Column, peer: Column, hops: int) -> Column:
    """The address that stands `hops` from the right in a forwarded chain, else the peer's."""
    parts = F.split(F.coalesce(forwarded, F.lit("")), ",")
    nth = F.when(F.size(parts) >= hops, F.trim(F.element_at(parts, -hops)))
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    address = nth.rlike(rf"^{byte}(\.{byte}){{3}}$") | (nth.rlike(r"^[0-9A-Fa-f:.]{2,45}$") & F.contains(nth, F.lit(":")))
    return F.when(address, nth).otherwise(peer)
