"""Language identification by word-first backoff.

A word that training saw scores by its log frequency in each language. An unseen word falls back to its longest
character n-grams that training saw, from five letters down to one, word ends marked; each step back costs a fixed
factor. A text's score in a language is the sum over all its words.

The model knows every language that a training row has, and every word and n-gram of the rows it is fitted on: a bounded sample of labelled rows (MAX_DOCS_PER_LANG of each language: a
language with more gives a share of 0.95 of that, drawn by a hash of the id, which a draw exceeds with a chance below one in a thousand). An item is a 64-bit hash with an entry
for each language that has it, some 20 bytes, and a language has one value for all items that it lacks, so the driver and the workers hold
what the sample holds, however many languages share it. Counting and scoring run in Arrow batches over the partitions of the input, with no shuffle of texts.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text when no row has a
language. Rows with a null or blank language don't train. Very long texts are scored whole. Repeated rows repeat their result.
Languages that score the same are decided by name. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm.common import crc_of_id, id_share, written

MAX_DOCS_PER_LANG = 4_000
LENGTHS = (5, 4, 3, 2, 1)
#: Log factor of a fall from words to n-grams, and of each shorter length.
BACKOFF = math.log(0.4)
#: Values (words times languages) that a worker keeps scored between texts, and new words that it scores at once.
KEPT_VALUES, AT_ONCE = 4_000_000, 20_000

WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; none when the text has no letter."""
    found = WORDS.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n), summed over each batch."""
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[lang].update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, gram, n): every word type counts once for each of its n-grams, weighted by the log of its frequency."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            weight = 1 + int(math.log2(n))
            for size in LENGTHS:
                for gram in grams_of(word, size):
                    counts[lang, size, gram] += weight
        rows = list(counts.items())
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k, _ in rows], pa.string()), "size": pa.array([k[1] for k, _ in rows], pa.int32()), "gram": pa.array([k[2] for k, _ in rows], pa.string()), "n": pa.array([n for _, n in rows], pa.int64())})


def hash_of(item: str) -> int:
    """The hash of an item, as Spark's xxhash64 has it."""
    return xxhash.xxh64_intdigest(item.encode(), 42)


class Logs:
    """The smoothed log frequency of items by language: a value for each language that has the item, and one for all items that a language lacks."""

    def __init__(self, hashes: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int):
        order = np.argsort(hashes, kind="stable")
        self.keys, at, size = np.unique(hashes[order], return_index=True, return_counts=True)
        self.at, self.size = at.astype(np.int32), size.astype(np.int32)
        self.langs = langs[order].astype(np.int32)
        totals = np.bincount(langs, counts, n_langs) + 0.5 * len(self.keys)
        self.lacking = np.log(0.5 / np.maximum(totals, 0.5))
        self.above = (np.log(counts[order] + 0.5) - math.log(0.5)).astype(np.float32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each item, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[i] == hashes, i, -1)

    def rows(self, places: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """n rows of values by language: the mean of the found items that belong to each, of giving each one's row."""
        size = self.size[places]
        entry = np.repeat(self.at[places], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros((n, len(self.lacking)))
        np.add.at(out, (np.repeat(of, size), self.langs[entry]), self.above[entry])
        return out / np.maximum(np.bincount(of, minlength=n), 1)[:, None] + self.lacking


def collected(counts: DataFrame, item: str, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, languages and counts of the counted items, as numbers."""
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    table = counts.select(F.xxhash64(item).alias("h"), number[F.col("lang")].alias("l"), F.col("n").cast("double").alias("n")).toArrow()
    h, lang, n = (table.column(c).to_numpy() for c in ("h", "l", "n"))
    return np.ascontiguousarray(h).view(np.uint64), lang, n


def fit(train: DataFrame, max_docs: int = MAX_DOCS_PER_LANG) -> dict:
    """The model from columns id, text and lang of the rows that may train: langs, and the Logs of words and of n-grams of each length."""
    train = train.where(F.col("lang").isNotNull() & (F.trim("lang") != "") & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "words": None, "grams": {}}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 0.95 * max_docs / n) if n > max_docs else 1.0)])
    drawn = train.where(id_share(F.col("id"), 11) < share[F.col("lang")])
    words = written(drawn.select("text", "lang").mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams = written(words.mapInArrow(count_grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "grams")
    model = {"langs": langs, "words": Logs(*collected(words, "word", langs), len(langs))}
    return model | {"grams": {size: Logs(*collected(grams.where(F.col("size") == size), "gram", langs), len(langs)) for size in LENGTHS}}


class Scorer:
    """Scores texts against a model, keeping the rows of recent words."""

    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.kept = max(AT_ONCE, KEPT_VALUES // max(1, len(self.langs)))
        self.at: dict[str, int] = {}
        self.rows = np.zeros((self.kept, max(1, len(self.langs))), np.float32)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The values of words: their own, or the mean of their longest n-grams that training saw."""
        out = np.zeros((len(words), len(self.langs)))
        place = self.words.find(np.fromiter(map(hash_of, words), np.uint64, len(words)))
        known = np.flatnonzero(place >= 0)
        out[known] = self.words.rows(place[known], np.arange(len(known)), len(known))
        left, cost = np.flatnonzero(place < 0), 0.0
        for size in LENGTHS:
            cost += BACKOFF
            grams = [grams_of(words[i], size) for i in left]
            of = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            place = self.grams[size].find(np.fromiter((hash_of(x) for g in grams for x in g), np.uint64, len(of)))
            seen = place >= 0
            some = np.unique(of[seen])
            out[left[some]] = self.grams[size].rows(place[seen], np.searchsorted(some, of[seen]), len(some)) + cost
            left = np.delete(left, some)
            if not len(left):
                break
        return out

    def places(self, words: list[str]) -> list[int]:
        """Row numbers of at most `kept` distinct words, scored where they are new."""
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.kept:
            self.at.clear()
            new = words
        for i in range(0, len(new), AT_ONCE):
            part, first = new[i : i + AT_ONCE], len(self.at)
            self.rows[first : first + len(part)] = self.rows_of(part)
            self.at.update(zip(part, range(first, first + len(part)), strict=True))
        return [self.at[w] for w in words]

    def scores(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Language and score of each text. Words that are new are looked up together for many texts."""
        held: list[list[str]] = []
        new: set[str] = set()
        for text in texts:
            held.append(words_of(text))
            new.update(w for w in held[-1] if w not in self.at)
            if len(new) > AT_ONCE // 2:
                yield from map(self.score, self.ready(held, new))
        yield from map(self.score, self.ready(held, new))

    def ready(self, held: list[list[str]], new: set[str]) -> list[list[str]]:
        if self.langs and len(self.at) + len(new) <= self.kept:
            self.places(sorted(new))
        out = list(held)
        held.clear()
        new.clear()
        return out

    def score(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.langs:
            return "und", 0.0
        counts = Counter(words)
        distinct, total = list(counts), np.zeros(len(self.langs))
        for i in range(0, len(distinct), self.kept):
            part = distinct[i : i + self.kept]
            total += np.array([counts[w] for w in part], float) @ self.rows[self.places(part)]
        odds = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(odds[best] / odds.sum())


def identify(df: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score (the winning language's share of the likelihood), one row for each row of df."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    part = df.select(*[df[c] for c in keep], df[text_col].alias("__text"))
    schema = part.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = list(scorer.scores(batch.column(batch.num_columns - 1).to_pylist()))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, "lang_pred", "score"])

    return part.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """True for rows that must not train: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(crc_of_id(doc_id) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = identify(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
