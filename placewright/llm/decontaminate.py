"""Benchmark decontamination: BM25 over an inverted index of the test items, searched by block-max WAND.

The index is small and the queries are the corpus: every passage of every training text is a query. Words are runs of
letters and digits in lower case. An item's BM25 weights are divided by the item's own full score, so a passage that
holds all of an item scores 1 and one threshold serves all items. Items are numbered by their rarest word's order and
lie in blocks of BLOCK; every word has its largest weight overall and in each block.

A text is passed over as soon as the block bounds of all its words together stay below the threshold, which is so for
nearly all. Otherwise its passages - windows of WINDOW words, each overlapping the next by half or more, so that
any item lies whole in one - are searched: cursors over the posting lists of the passage's words, a pivot where the
sum of word bounds reaches the threshold, then the sum of block bounds, then the score; a failed block bound skips to
the end of the block. All items at or above the threshold come back, none is cut off.

A hit counts when the text holds the item's question and answer: the first part and the last part of the item (its
last sentence, or its last third if it is one sentence) are looked up in the text around the passage; each part must
be there to QUESTION and ANSWER. A part is there to the greater of two shares: of its shingles of five words (of all
its words, if it has fewer) that the text has, and of its words that need no edit to stand in the text in a row, so
that one changed word doesn't lose a part. An item too short for two parts of five words is looked up whole.

Posting lists and block bounds are sparse: an index takes space for the words that its items hold. It is built in parts of MAX_ITEMS items and a scan of
the texts searches PARTS of them, so the size of a broadcast is bounded however many items there are; more items take more scans. Word rarity and mean
length are those of all items. Texts are not shuffled: `drop_contaminated` filters rows where they are read, each by its own text.

Defined cases: a null or empty text matches nothing, nor does an item without words. Items of fewer than five words
must be there word for word. An item without an id is reported with a null item_id. Equal items and items that repeat an id are reported each; repeated
documents are reported each time, also those without an id. Very long texts are searched whole. Empty tables give an empty result. Extra
columns are ignored, and kept by drop_contaminated, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER = 0.8, 0.8, 0.8
#: Items of one index (some 30 MB with items of 50 words), and indexes that one scan of the texts searches.
SHINGLE, BLOCK, MAX_ITEMS, PARTS = 5, 4, 4_000, 4

WORDS = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)")

MATCH_FIELDS = "item_id long, passage long, score double, question_overlap double, answer_overlap double"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def shingles(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def edits(part: list[str], words: list[str]) -> int:
    """The fewest words to insert, delete or replace that make the part a run of the words (Myers' bit vectors, one bit for each word of the part)."""
    at: dict[str, int] = {}
    for i, w in enumerate(part):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(part)) - 1, 1 << len(part) - 1
    up, down, now = full, 0, len(part)
    least = now
    for w in words:
        equal = at.get(w, 0)
        level = (((equal & up) + up) ^ up) | equal
        more, less = (down | ~(level | up)) & full, up & level
        now += bool(more & top) - bool(less & top)
        least = min(least, now)
        more, less = more << 1 & full, less << 1 & full
        level = equal | down
        up, down = (less | ~(level | more)) & full, more & level
    return least


def overlap(part: list[str], words: list[str]) -> float:
    """To what share the words hold the part."""
    width = min(SHINGLE, len(part))
    own = shingles(part, width)
    share = len(own & shingles(words, width)) / len(own)
    return share if share == 1 else max(share, (len(part) - edits(part, words)) / len(part))


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words but for its last sentence, and those of that sentence; of a single sentence the first two thirds and the rest.
    The whole item twice if two thirds are fewer than SHINGLE words."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    for end in reversed(ends):
        question, answer = words_of(text[:end]), words_of(text[end:])
        if len(answer) >= SHINGLE and len(question) >= SHINGLE:
            return question, answer
    words = words_of(text)
    cut = max(1, 2 * len(words) // 3)
    return (words[:cut], words[cut - SHINGLE + 1 :]) if cut >= SHINGLE else (words, words)


class Index:
    """Posting lists of a part of the items, with word and block bounds. overall: items with words, their mean length and the items of each word, if items aren't all there are."""

    def __init__(self, items: list[tuple[int, str]], overall: tuple[int, float, dict[str, int]] | None = None):
        docs = [(i, t, words_of(t)) for i, t in items]
        docs = [d for d in docs if d[2]]
        n, mean, df = overall or (len(docs), np.mean([len(w) for *_, w in docs]) if docs else 1.0, Counter(w for *_, words in docs for w in set(words)))
        idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for *_, words in docs for w in set(words) if (k := df[w])}
        # items that share their rarest word lie together, which keeps block bounds tight
        docs.sort(key=lambda d: (max((idf[w], w) for w in d[2]), d[0] is None, d[0] or 0, d[1]))
        self.ids = [d[0] for d in docs]
        self.parts = [question_and_answer(t) for _, t, _ in docs]
        self.longest = max((len(w) for *_, w in docs), default=1)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, (_, _, words) in enumerate(docs):
            tf = Counter(words)
            weight = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for w, f in tf.items()}
            own = sum(weight.values())
            for w, x in weight.items():
                postings[w].append((at, x / own))
        self.word = {w: i for i, w in enumerate(postings)}
        self.items = [[at for at, _ in p] for p in postings.values()]
        self.weights = [[x for _, x in p] for p in postings.values()]
        self.bound = np.array([max(p) for p in self.weights] or [0.0])
        self.blocks: list[dict[int, float]] = []
        for ats, ws in zip(self.items, self.weights, strict=True):
            most: dict[int, float] = {}
            for at, x in zip(ats, ws, strict=True):
                most[at // BLOCK] = max(x, most.get(at // BLOCK, 0.0))
            self.blocks.append(most)
        self.block_ids = [np.fromiter(m.keys(), np.int32, len(m)) for m in self.blocks]
        self.block_most = [np.fromiter(m.values(), np.float64, len(m)) for m in self.blocks]

    def may_match(self, terms: list[int], threshold: float) -> bool:
        if not terms or self.bound[terms].sum() < threshold:
            return False
        ids, most = (np.concatenate([x[t] for t in terms]) for x in (self.block_ids, self.block_most))
        return np.bincount(ids, most).max() >= threshold - 1e-4

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms reaches the threshold, by block-max WAND."""
        bound, blocks, items, weights = self.bound, self.blocks, self.items, self.weights
        threshold -= 1e-9
        cursors = [[items[t][0], 0, t] for t in terms]  # current item, position in the posting list, word
        found = []

        def advance(c: list, item: int) -> None:
            """Moves a cursor to its first item from `item` on."""
            list_, i = items[c[2]], c[1]
            while i < len(list_) and list_[i] < item:
                i += 1
            c[1], c[0] = i, list_[i] if i < len(list_) else math.inf

        while True:
            cursors = sorted(c for c in cursors if c[0] != math.inf)
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += bound[c[2]]
                if total >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(blocks[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) < threshold - 1e-4:
                # no item of this block before the next cursor can reach it
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
                to = min((block + 1) * BLOCK, after)
                for c in cursors[: pivot + 1]:
                    advance(c, to)
                continue
            if cursors[0][0] == item:
                score = sum(weights[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    advance(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    advance(c, item)

    def matches(self, text: str | None, threshold: float, question: float, answer: float) -> list[tuple[int, int, float, float, float]]:
        """(item, first word of the best passage, score, question overlap, answer overlap) of each item that the text holds."""
        if not text:
            return []
        words = words_of(text)
        ids = [self.word.get(w, -1) for w in words]
        if not self.may_match(list({i for i in ids if i >= 0}), threshold):
            return []
        window = 2 * self.longest
        step = window - self.longest
        best: dict[int, tuple[float, int]] = {}
        for at in range(0, max(1, len(words) - self.longest), step):
            terms = list({i for i in ids[at : at + window] if i >= 0})
            if self.may_match(terms, threshold):
                for item, score in self.search(terms, threshold):
                    if score > best.get(item, (0.0, 0))[0]:
                        best[item] = score, at
        out = []
        for item, (score, at) in sorted(best.items()):
            around = words[max(0, at - step) : at + window + step]
            q, a = (overlap(p, around) for p in self.parts[item])
            if q < question or a < answer:  # equal scores elsewhere: the whole text decides
                q, a = (overlap(p, words) for p in self.parts[item])
            if q >= question and a >= answer:
                out.append((self.ids[item], at, score, q, a))
        return out


@F.pandas_udf(T.StructType().add("n", T.LongType()).add("words", T.ArrayType(T.StringType())))
def distinct_words(texts: pd.Series) -> pd.DataFrame:
    """How many words each text has, and the different ones."""
    found = [words_of(t) for t in texts]
    return pd.DataFrame({"n": [len(w) for w in found], "words": [sorted(set(w)) for w in found]})


def shared_indexes(items: DataFrame, max_items: int) -> Iterator[Broadcast]:
    """The items' indexes, PARTS of them at a time."""
    spark = items.sparkSession
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    parts = max(1, -(-items.count() // max_items))
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    if parts > 1:  # one part's own figures are those of all items
        spread = items.select(part_of.alias("part"), distinct_words("text").alias("found"))
        each = spread.select("part", F.explode("found.words").alias("word"))
        counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("k"))
        total = spread.where("found.n > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("found.n"), F.lit(1.0)).alias("mean")).first()
    for first in range(0, parts, PARTS):
        overall, last = None, min(parts, first + PARTS)
        if parts > 1:
            here = each.where(F.col("part").between(first, last - 1)).select("word").distinct()
            overall = total.n, total.mean, {r.word: r.k for r in counts.join(here.hint("merge"), "word").collect()}
        yield spark.sparkContext.broadcast([Index([(r.item_id, r.text) for r in items.where(part_of == part).collect()], overall) for part in range(first, last)])


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    threshold: float = THRESHOLD,
    question: float = QUESTION,
    answer: float = ANSWER,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """One row for each document (kept columns) and item it holds, with the passage and the overlaps.

    docs has the column text, items the columns item_id and text."""
    rows = docs.select(*keep, "text")
    schema = rows.select(*keep).schema
    for field in MATCH_FIELDS.split(", "):
        schema = schema.add(*field.split())

    def scan(shared: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, hits = [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    for hit in (h for index in shared.value for h in index.matches(text, threshold, question, answer)):
                        at.append(i)
                        hits.append(hit)
                columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(batch.num_columns - 1)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                columns += [pa.array([h[i] for h in hits], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        return rows.mapInArrow(search, schema)

    return reduce(DataFrame.unionByName, map(scan, shared_indexes(items, max_items)))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", max_items: int = MAX_ITEMS) -> DataFrame:
    """The rows of docs whose text holds no item, in the columns of docs."""
    at = docs.columns.index(text_col)

    def scan(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = (any(index.matches(text, THRESHOLD, QUESTION, ANSWER) for index in shared.value) for text in batch.column(at).to_pylist())
                yield batch.filter(pa.array([not h for h in held], pa.bool_()))

        return rows.mapInArrow(clean, docs.schema)

    return reduce(scan, shared_indexes(items, max_items), docs)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
