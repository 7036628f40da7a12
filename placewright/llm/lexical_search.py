"""Ranked lexical search of all documents for each benchmark item, by a frequent-pattern tree of documents.

Documents are restricted to the words of the items. Each task puts its documents into trees of up to BLOCK_DOCS documents and
BLOCK_ENTRIES words: a document is the list of its words, most frequent in the corpus first, and documents whose lists begin alike
share a path. A node holds, for each word of the documents below it, the greatest tf, and their least m; a header
lists the nodes of each word. As a score grows with tf and falls with m, these give a bound for all documents below a node.
An item is searched depth first, best bound first: what is bounded below the item's current tenth score is left out, and the
documents of a leaf (about LEAF neighbours) are scored exactly. The tenth score goes on from one tree of a task to the
next. Only each task's best rows of an item are shuffled, first into SPREAD parts of an item, then whole.

Words are maximal runs of letters, digits and characters beyond 0x7F; only A-Z are made small. N, L and df are those of
all documents. Items are searched in parts of MAX_ITEMS, whose words and weights are broadcast; each part reads
the texts once and its rows are written before the next.

Defined cases: a null text has no words, nor has a null item, which finds nothing. Rows of items that are equal in id and text
are one item; other texts under one id are items of their own, as is a null id. Repeated documents are ranked each; of
equal scores the smaller doc_id comes first, null last. Very long texts are read whole. Empty tables give an empty
result. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.common import written

TOP = 10
#: Items whose words are broadcast at once; documents and words of a tree; documents of a leaf; parts that an item's rows are gathered in first.
MAX_ITEMS, BLOCK_DOCS, BLOCK_ENTRIES, LEAF, SPREAD = 4_000, 8_192, 2_000_000, 24, 64

#: Letters A-Z become small; all other bytes up to 0x7F but digits and a-z become blanks; bytes of other characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

VECTORS = "doc_id long, n long, words array<int>, tfs array<long>"
FOUND = "item int, doc_id long, score long"


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(WORD_BYTES).split() if raw else []


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """A tree of documents: nodes in order of creation, children before their parent, the root last.

    words: lists of word numbers, the most frequent word of the corpus being 0, in one array cut by `ends`; tfs beside them; m of each document."""

    def __init__(self, ids: list[int | None], ends: np.ndarray, words: np.ndarray, tfs: np.ndarray, m: np.ndarray, vocabulary: int, leaf: int = LEAF):
        starts = np.concatenate([[0], ends[:-1]])
        of = np.repeat(np.arange(len(ids)), ends - starts)
        order = np.lexsort((words, of))  # each document's words, the most frequent first
        words, tfs = words[order], tfs[order]
        paths = [words[a:b].astype(">u4").tobytes() for a, b in zip(starts, ends, strict=True)]
        docs = sorted(range(len(ids)), key=paths.__getitem__)
        spans = [np.arange(starts[d], ends[d]) for d in docs]
        at = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        self.ids, self.m = [ids[d] for d in docs], m[docs]
        self.ends = np.cumsum([len(s) for s in spans])
        self.starts = self.ends - [len(s) for s in spans]
        self.words, tfs = words[at], tfs[at]
        self.saturated = saturation(tfs, np.repeat(self.m, self.ends - self.starts))
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        self._most = np.zeros(vocabulary, np.int64)
        self._nodes: list[tuple[np.ndarray, np.ndarray]] = []
        self._tfs, self._leaf = tfs, leaf
        if ids:
            self._build(0, len(ids), 0)
        self.least = np.array([int(self.m[a:b].min()) for a, b in self.span], np.int64)
        held = [w for w, _ in self._nodes] or [np.zeros(0, np.int64)]
        node = np.repeat(np.arange(len(self._nodes)), [len(w) for w in held[: len(self._nodes)]])
        word, most = np.concatenate(held), np.concatenate([t for _, t in self._nodes] or [np.zeros(0, np.int64)])
        by_word = np.argsort(word, kind="stable")
        self.header = np.searchsorted(word[by_word], np.arange(vocabulary + 1))
        self.header_node = node[by_word]
        self.header_saturated = saturation(most, self.least[node])[by_word] if len(node) else np.zeros(0, np.int64)

    def _add(self, first: int, last: int, children: list[int]) -> int:
        """A node over the documents first to last, with the greatest tf of each word from its children or its documents."""
        parts = [self._nodes[c] for c in children] or [(self.words[self.starts[first] : self.ends[last - 1]], self._tfs[self.starts[first] : self.ends[last - 1]])]
        for w, t in parts:
            np.maximum.at(self._most, w, t)
        held = np.unique(np.concatenate([w for w, _ in parts]))
        self._nodes.append((held, self._most[held]))
        self._most[held] = 0
        self.children.append(children)
        self.span.append((first, last))
        return len(self._nodes) - 1

    def _build(self, first: int, last: int, depth: int) -> int:
        """The node of documents that share their first `depth` words."""
        while last - first > self._leaf:
            here = np.where(self.starts[first:last] + depth < self.ends[first:last], self.words[np.minimum(self.starts[first:last] + depth, len(self.words) - 1)], -1)
            cuts = np.flatnonzero(np.diff(here)) + 1
            if len(cuts):
                break
            if here[0] < 0:
                return self._add(first, last, [])  # equal lists
            depth += 1
        else:
            return self._add(first, last, [])
        edges = [first, *(first + cuts).tolist(), last]
        children, since = [], first
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > self._leaf:  # small neighbours share a leaf
                if since < a:
                    children.append(self._add(since, a, []))
                children.append(self._build(a, b, depth + 1))
                since = b
            elif b - since > self._leaf:
                if since < a:
                    children.append(self._add(since, a, []))
                since = a
        if since < last:
            children.append(self._add(since, last, []))
        return self._add(first, last, children)

    def search(self, terms: np.ndarray, weights: np.ndarray, of_word: np.ndarray, best: list, top: int) -> list:
        """best, [(-score, id is null, id)] in order, after the documents of this tree. of_word: zeros, one for each word of the vocabulary."""
        if not self.children:
            return best
        slices = [slice(self.header[t], self.header[t + 1]) for t in terms]
        nodes = np.concatenate([self.header_node[s] for s in slices])
        bounds = np.zeros(len(self.children), np.int64)
        np.add.at(bounds, nodes, np.concatenate([w * self.header_saturated[s] for w, s in zip(weights, slices, strict=True)]))
        of_word[terms] = weights
        stack = [len(self.children) - 1]
        while stack:
            node = stack.pop()
            bound = bounds[node]
            if bound <= 0 or (len(best) == top and bound < -best[-1][0]):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bounds.__getitem__)
                continue
            first, last = self.span[node]
            a, b = self.starts[first], self.ends[last - 1]
            sums = np.concatenate([[0], np.cumsum(of_word[self.words[a:b]] * self.saturated[a:b])])
            scores = sums[self.ends[first:last] - a] - sums[self.starts[first:last] - a]
            least = -best[-1][0] if len(best) == top else 1
            near = np.flatnonzero(scores >= max(1, least))
            if len(near):
                best = sorted([*best, *((-int(scores[i]), (x := self.ids[first + i]) is None, x or 0) for i in near)])[:top]
        of_word[terms] = 0
        return best


def restricted(docs: DataFrame, words: Broadcast) -> DataFrame:
    """doc_id, number of words, and numbers and tfs of those words that the items have; documents without any word are left out."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = words.value
        for batch in batches:
            rows, ns, ends, at, tfs = [], [], [0], [], []
            for i, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if all_words := words_of(raw):
                    for w, tf in Counter(all_words).items():
                        if w in number:
                            at.append(number[w])
                            tfs.append(tf)
                    rows.append(i)
                    ns.append(len(all_words))
                    ends.append(len(at))
            cut = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), cut(at, pa.int32()), cut(tfs, pa.int64())], ["doc_id", "n", "words", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(vectors, VECTORS)


def best_of_tasks(vectors: DataFrame, search: Broadcast, top: int, block_docs: int, block_entries: int, leaf: int) -> DataFrame:
    """Each task's best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_words, place, items = search.value
        of_word = np.zeros(len(place), np.int64)
        best: list[list] = [[] for _ in items]
        held: list[tuple] = []

        def searched() -> None:
            ids, ns, lengths, words, tfs = ([x for part in held for x in part[k]] if k == 0 else np.concatenate([part[k] for part in held]) for k in range(5))
            m = np.array([100 - 90 + 90 * int(n) * n_docs // n_words for n in ns], np.int64)
            tree = Tree(ids, np.cumsum(lengths), place[words].astype(np.int64), tfs, m, len(place), leaf)
            for k, (terms, weights) in enumerate(items):
                if len(terms):
                    best[k] = tree.search(terms, weights, of_word, best[k], top)
            held.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, block_docs):
                batch = whole.slice(at, block_docs)
                words, tfs = batch.column(2), batch.column(3)
                held.append((batch.column(0).to_pylist(), batch.column(1).to_numpy(), np.diff(words.offsets.to_numpy()), words.flatten().to_numpy(), tfs.flatten().to_numpy()))
                if sum(len(part[0]) for part in held) >= block_docs or sum(len(part[3]) for part in held) >= block_entries:
                    searched()
        if held:
            searched()
        rows = [(k, None if none else doc, -score) for k, found in enumerate(best) for score, none, doc in found]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "doc_id", "score"])

    return vectors.where(F.size("words") > 0).mapInArrow(run, FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, max_items: int = MAX_ITEMS, block_docs: int = BLOCK_DOCS, block_entries: int = BLOCK_ENTRIES, leaf: int = LEAF) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents. docs has doc_id and text, items item_id and text."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    parts = max(1, -(-asked.count() // max_items))
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    asked = written(asked.withColumn("part", part_of), "items")
    first = Window.orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    answers = []
    for part in range(parts):
        rows = asked.where(F.col("part") == part).select("item_id", "text").collect()
        texts = [sorted(set(words_of(r.text.encode()))) for r in rows]
        number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        vectors = written(restricted(docs, spark.sparkContext.broadcast(number)), "vectors")
        total = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words")).first()
        df = np.zeros(len(number), np.int64)
        for r in vectors.select(F.explode("words").alias("word")).groupBy("word").count().collect():
            df[r.word] = r["count"]
        place = np.empty(len(number), np.int64)
        place[np.argsort(-df, kind="stable")] = np.arange(len(number))
        weight = [math.floor(1000 * math.log((2 * total.n + 2) / (2 * int(k) + 1))) for k in df]
        wanted = [[number[w] for w in t if df[number[w]]] for t in texts]
        plan = [(place[np.array(t, np.int64)], np.array([weight[i] for i in t], np.int64)) for t in wanted]
        found = best_of_tasks(vectors, spark.sparkContext.broadcast((total.n, total.words, place, plan)), top, block_docs, block_entries, leaf)
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item int, item_id long")
        some = first.partitionBy("item", "spread")
        found = found.withColumn("spread", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
        found = found.withColumn("rank", F.row_number().over(first.partitionBy("item"))).where(F.col("rank") <= top)
        answers.append(written(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "answers"))
    return reduce(DataFrame.unionByName, answers)


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return ranked_search(read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text"))


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
docs AS (SELECT row_id, doc_id, len(ws) AS n, ws FROM words WHERE len(ws) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM docs),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(ws) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weighted AS (SELECT item_id, term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN df USING (term), total),
m AS (SELECT row_id, doc_id, 100 - 90 + (90 * n * n_docs) // n_words AS m FROM docs, total),
scores AS (
  SELECT item_id, row_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM weighted JOIN tf USING (term) JOIN m USING (row_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""
