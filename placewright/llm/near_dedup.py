"""Near-duplicates by SetSketch: banded registers give candidates, a joint likelihood weeds them, full sets confirm.

A document's set holds the hashes of its distinct word shingles. Its sketch has M registers: register i is the floor of
1 - log_b of the smallest of the set's exponentially spaced hash values under function i, cut to 16 bits. Registers
are minima, so sketches merge by the larger register, and two sets' registers agree about as often as the sets overlap.

1. Sketch: one pass over the texts, written once (some 700 bytes a document). A set's node is a 64-bit hash of it.
2. Documents with equal sets collapse to one node, by a grouped minimum with map-side combine. Only those go on.
3. Banding: ROWS registers a band. Two sets at similarity 0.8 share no band with a chance of 6 in 100,000. In each bucket every
   set is paired with the bucket's smallest node only, so a bucket of any size gives as many pairs as it has members.
4. Weeding: with both set sizes known, the similarity of maximum likelihood given how many registers are larger, smaller and equal. Pairs
   more than five standard errors below the threshold go.
5. Verification on the full sets, recomputed from the texts of candidates only, which a bit map of fixed size picks. A leader with many candidates is dealt
   in parts of PART candidates; each task holds one leader's set and streams the others.
6. Components of the confirmed links. A bucket whose members then lie in different components has pairs that could
   still join them: another leader from the largest component is tried against those outside it, then all
   pairs across components are compared in tiles, by sketch and then by full sets. So the result is the components of all links between sets that
   share a band. Nothing is capped.

`drop_near_duplicates` keeps whole rows: those that no other row resembles stay where they are, and of the others one a
component and map task moves.

Defined cases: a text without words, or null, has an empty set, is linked with nothing and is its own component. With
fewer words than a shingle the whole sequence is one. Equal sets are linked whatever the texts. Rows are linked by what they
hold, so rows that repeat an id, or have none, are documents of their own; a null id is larger than all others. Very long texts are read whole. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.llm.common import dealt_join, first_rows, sifted, written
from placewright.llm.components import components

M, ROWS = 192, 6
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Candidates of one leader that a task compares.
PART = 2_000
#: Turns in which each open bucket tries one more leader, and the side of a tile of members compared at once.
LEADER_ROUNDS, TILE = 1, 1_000
KEPT_WORDS = 300_000

_seeds = np.random.default_rng(20)
SEEDS = _seeds.integers(0, 1 << 32, M, dtype=np.uint32)
FACTORS = _seeds.integers(0, 1 << 32, M, dtype=np.uint32) | np.uint32(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text; ASCII capitals and small letters are one."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * STEP + w[i : len(w) - n + 1 + i]
        return np.unique(mix(h))


def registers(values: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.empty(M, np.uint32)
    each = max(1, 400_000 // len(x))
    for i in range(0, M, each):
        least[i : i + each] = ((x[None, :] ^ SEEDS[i : i + each, None]) * FACTORS[i : i + each, None]).min(axis=1)
    spaced = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(spaced) / math.log(BASE)), 0, TOP).astype("<u2")


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    parts = sketches.reshape(len(sketches), M // ROWS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, M // ROWS + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for i in range(ROWS):
            key = mix(key * STEP + parts[:, :, i])
    return key.view(np.int64)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of maximum likelihood for pairs of sketches whose sets have na and nb members."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)[None, :]
    p = lambda x: np.maximum(1e-12, -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE))
    up, down = p(u - v * j), p(v - u * j)
    score = more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(np.maximum(1e-12, 1 - up - down))
    return j[np.arange(len(j)), score.argmax(axis=1)]


def node_of(held: np.ndarray) -> int:
    """A set's node."""
    return int.from_bytes(hashlib.blake2b(held.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketched(df: DataFrame, size: int) -> DataFrame:
    """id, n_shingles, node (null if the set is empty), regs and band keys, from the columns id and text."""
    schema = df.select("id").schema.add("n_shingles", "long").add("node", "long").add("regs", "binary").add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            held = [i for i, s in enumerate(sets) if len(s)]
            regs = np.stack([registers(sets[i]) for i in held]) if held else np.zeros((0, M), "<u2")
            nodes, sketch, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            keys = band_keys(regs)
            for k, i in enumerate(held):
                nodes[i], sketch[i], bands[i] = node_of(sets[i]), regs[k].tobytes(), keys[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "n_shingles", "node", "regs", "bands"],
            )

    return df.select("id", "text").mapInArrow(run, schema)


def weeded(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose likely similarity is not clearly below the threshold."""
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / M)
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(n, M) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            # no similarity exceeds the ratio of the sizes
            keep = (likely_similarity(ra, rb, na, nb) >= least) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def texts_of(docs: DataFrame, wanted: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of `wanted`, which has a node each, with the text of every document whose id is that of the node's representative. Rows that repeat an id
    all come along, so a reader checks the set. Only texts whose id a bit map holds are shuffled."""
    keyed = written(wanted.join(reps.select("node", "key").hint("merge"), "node"), "wanted")
    texts = docs.select(F.xxhash64("id").alias("key"), "text")
    return sifted(texts, F.col("key"), keyed).where("__held").drop("__held").join(keyed.hint("merge"), "key").drop("key")


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose full sets have 100 * common >= percent * union."""
    parts = pairs.groupBy("a").agg((F.count(F.lit(1)) / PART + 1).cast("int").alias("parts"))
    dealt = pairs.join(parts.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    wanted = dealt.select("a", "part", "b", F.col("b").alias("node")).unionByName(
        dealt.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("node")).distinct()
    )
    rows = texts_of(docs, wanted, reps).select("a", "part", "b", "node", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, leader, own = WordHashes(), None, None
        for batch in batches:
            found_a, found_b = [], []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for a, part, b, node, text in zip(*columns, batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if b is None and (a, part) == leader:
                    continue
                held = shingle_set(text, hashes, size)
                if not len(held) or node_of(held) != node:  # another document of that id
                    continue
                if b is None:
                    leader, own = (a, part), held
                elif alike(own, held, percent):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_b, pa.int64()), pa.array(found_a, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long").distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component) of the buckets whose members lie in several components."""
    labelled = members.select("key", "node").join(labels.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return written(labelled.join(several.hint("merge"), "key", "left_semi"), "open")


def sized(spread: DataFrame, labels: DataFrame) -> DataFrame:
    """The open members with n, the size of their component."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return dealt_join(spread, sizes, ["component"], "left", F.xxhash64("key", "node")).withColumn("n", F.coalesce("n", F.lit(0)))


def leader_pairs(spread: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """One leader for each open bucket, from its largest component and another one each turn, with the members of other components."""
    leads = sized(spread, labels).groupBy("key").agg(F.max_by(F.struct("node", "component"), F.struct("n", F.xxhash64("node", F.lit(turn)))).alias("lead"))
    both = spread.join(leads.hint("merge"), "key").where(F.col("component") != F.col("lead.component"))
    return both.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def across_components(spread: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The confirmed pairs (u, v) of an open bucket across components.

    Members meet in tiles: those outside a bucket's largest component are cut into parts of TILE, as are all its members, and a task compares one
    part with another, first by sketch, then by full sets, so only links become rows. A pair counts in the first bucket that it shares."""
    threshold = percent / 100
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / M)
    main = sized(spread, labels).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("members"))
    rows = spread.join(main.hint("merge"), "key").withColumn("outside", F.col("component") != F.col("main"))
    outside = rows.groupBy("key").agg(F.count_if("outside").alias("few"))
    rows = rows.join(outside.hint("merge"), "key").withColumns({"px": F.ceil(F.col("few") / TILE).cast("int"), "py": F.ceil(F.col("members") / TILE).cast("int")})
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    xs = rows.where("outside").select("key", "node", "component", part("px").alias("x"), every("py").alias("y"), F.lit(0).alias("side"))
    ys = rows.select("key", "node", "component", every("px").alias("x"), part("py").alias("y"), F.lit(1).alias("side"))
    sketch = reps.select("node", "n_shingles", "regs").hint("merge")
    texts = texts_of(docs, spread.select("node").distinct(), reps).hint("merge")
    dealt = xs.unionByName(ys).join(sketch, "node").join(texts, "node").select("key", "x", "y", "side", "node", "component", "n_shingles", "regs", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, hashes = None, [], WordHashes()
        for batch in batches:
            out_a, out_b = [], []
            sets = [shingle_set(t, hashes, size) for t in batch.column(8).cast(pa.binary()).to_pylist()]
            own = [len(s) > 0 and node_of(s) == node for s, node in zip(sets, batch.column(4).to_pylist(), strict=True)]  # else another document of that id
            batch, sets = batch.filter(pa.array(own, pa.bool_())), [s for s, o in zip(sets, own, strict=True) if o]
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            nodes, comps, sizes = (batch.column(i).to_numpy() for i in (4, 5, 6))
            regs = np.frombuffer(b"".join(batch.column(7).to_pylist()), "<u2").reshape(-1, M)
            bands = band_keys(regs)
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at][:3] != tile:
                    tile, held = keys[at][:3], []
                if keys[at][3] == 0:
                    held += [(nodes[i], comps[i], sizes[i], regs[i], bands[i], sets[i]) for i in range(at, end)]
                else:
                    for i, c, n, r, b, full in held:
                        of = np.arange(at, end)[comps[at:end] != c]
                        of = of[np.minimum(sizes[of], n) >= threshold * np.maximum(sizes[of], n) - 1e-9]
                        if not len(of):
                            continue
                        shared = bands[of] == b
                        of = of[b[shared.argmax(axis=1)] == keys[at][0]]
                        if len(of):
                            like = likely_similarity(np.broadcast_to(r, (len(of), M)), regs[of], np.full(len(of), float(n)), sizes[of].astype(float))
                            for j in of[like >= least]:
                                if alike(full, sets[j], percent):
                                    out_a.append(max(i, nodes[j]))
                                    out_b.append(min(i, nodes[j]))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["u", "v"])

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side").mapInArrow(run, "u long, v long").distinct()


def set_components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """From the columns id and text: id, n_shingles and node of each row, and component and component_id (the smallest id) of each node."""
    sketches = written(sketched(docs, size), "sketches")
    first = F.struct(F.col("id").isNull(), F.col("id"))
    reps = sketches.where("node is not null").groupBy("node").agg(F.min_by(F.struct(F.xxhash64("id").alias("key"), "id", "n_shingles", "regs", "bands"), first).alias("r"))
    reps = written(reps.select("node", "r.*"), "sets")
    keys = reps.select("node", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(heads.hint("merge"), "key").select("key", "head", "node"), "members")
    pairs = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    links = written(confirmed(weeded(pairs, reps, percent / 100), docs, reps, size, percent), "links")
    labels, tried = components(links), pairs
    for turn in range(LEADER_ROUNDS):
        more = written(leader_pairs(open_members(members, labels), labels, turn).join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(more)
        new = written(confirmed(weeded(more, reps, percent / 100), docs, reps, size, percent), "links")
        if not new.limit(1).count():
            break
        links = links.unionByName(new)
        labels = components(links)
    rest = written(across_components(open_members(members, labels), labels, reps, docs, size, percent), "links")
    if rest.limit(1).count():
        labels = components(links.unionByName(rest))
    own = reps.select("node", "id").join(labels.hint("merge"), "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("id").alias("component_id"))
    nodes = dealt_join(own.select("node", "component"), least, ["component"], "inner", F.xxhash64("node"))
    return sketches.select("id", "n_shingles", "node"), written(nodes, "nodes")


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable over links) and kept, one row for each row of df."""
    rows, nodes = set_components(df.select(df[id_col].alias("id"), df[text_col].alias("text")), size, percent)
    linked = dealt_join(rows.where("node is not null"), nodes.select("node", "component_id"), ["node"], "inner", F.xxhash64("id"))
    alone = rows.where("node is null").withColumn("component_id", F.col("id"))
    out = linked.select("id", "n_shingles", "component_id").unionByName(alone.select("id", "n_shingles", "component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), size=4, percent=80)


def noded(df: DataFrame, size: int) -> DataFrame:
    """df with `node`, the set of its column __text."""
    names, at = df.columns, df.columns.index("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes, size) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*names, "node"])

    return df.mapInArrow(run, df.select("*").schema.add("node", "long"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: the one with the smallest id. Rows are judged by their own texts."""
    rows, nodes = set_components(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), size, percent)
    counts = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    several = nodes.join(counts.hint("merge"), "node").groupBy("component").agg(F.sum("rows").alias("rows")).where("rows > 1").select("component")
    grouped = dealt_join(nodes, several, ["component"], "left_semi", F.xxhash64("node")).select("node", "component")
    ids = dealt_join(rows, grouped, ["node"], "left_semi", F.xxhash64("id")).select(F.xxhash64("id").alias("key"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    marked = sifted(whole, F.xxhash64("__id"), ids)
    found = noded(marked.where("__held").drop("__held"), size).drop("__text")
    # what only its id brought here has no group, and stays as it is
    found = dealt_join(found, grouped, ["node"], "left", F.xxhash64("__id"))
    one = first_rows(found.where("component is not null").select("component", "__row", "__id"), "component", "__id")
    kept = marked.where("not __held").select("__row").unionByName(found.where("component is null").select("__row")).unionByName(one.select("__row"))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w = [''] THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
