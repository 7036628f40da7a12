"""Source divergence audit by count-level bitmaps.

A group is a (language, source) pair. A term's share in a group depends on the term's count there alone, so the terms of a group
fall into levels of equal count. Two groups of a language are compared by the joint cells (count here, count there): the
number of terms in a cell times the divergence of its two shares, with the terms that neither group has by complement.

The kept terms of a language are dealt by hash to chunks of about CHUNK terms. In a chunk a level is a bitset over the
chunk's term ids if it holds at least one term in 64 of them, and a list of ids otherwise, so a chunk takes a bounded space
whatever the counts are. Cells of two bitsets are found by AND and popcount, cells with a list by looking its ids up.
All groups of a language are compared tile by tile: a task gets one chunk of at most 2 * SOURCES groups.

Texts are read once: each task adds up its terms by group before anything is shuffled, and hands over what it has whenever
MOST_COUNTS counts are held. Counts meet by (language, term), where the terms of fewer than MIN_DOCS documents go; what
stays is written. All arithmetic is on integers; divisions round down.

Defined cases: null text, language and source are empty strings. A group without terms has every kept term at count 0; a
language without kept terms has pairs of value 0 and no terms. A language of one source has no pairs. Equal values are
ordered by the item's UTF-8. Repeated rows are documents each. Very long texts are read whole. An empty table gives an
empty result. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.common import dealt_join, written

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
#: Terms of a chunk, sources of a tile's side, counts that a task holds before it hands them over, groups that are broadcast at most.
CHUNK, SOURCES, MOST_COUNTS, MOST_BROADCAST = 16_384, 64, 400_000, 100_000

#: Letters A-Z become small, all other bytes up to 0x7F but a-z become blanks; bytes of other letters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, source, term) and of the documents that hold the term; the empty term stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_over() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in groups.items():
            terms = [b"", *counts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([0, *counts.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, counts)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for batch in batches:
        lang, source, text = (batch.column(i) for i in range(3))
        held = sum(len(counts) for counts, _ in groups.values())
        for key, raw in zip(zip(lang.to_pylist(), source.to_pylist(), strict=True), text.cast(pa.binary()).to_pylist(), strict=True):
            if key not in groups:
                groups[key] = Counter(), Counter()
            counts, docs = groups[key]
            terms = raw.translate(LETTERS).split()
            held -= len(counts)
            counts.update(terms)
            docs.update(set(terms))
            held += len(counts)
            if held > MOST_COUNTS:
                yield from handed_over()
                held = 0
    yield from handed_over()


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact for any counts."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide, total.cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, total (of the lang) and first (true in one row of each term); the empty term marks a group."""
    text = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = text.mapInArrow(count_terms, COUNTED).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    rows = counted.withColumns({"docs": F.sum("docs").over(of), "total": F.sum("n").over(of), "first": F.row_number().over(of.orderBy("source")) == 1})
    return written(rows.where((F.col("term") == "") | (F.col("docs") >= min_docs)).drop("docs"), "terms")


def group_table(terms: DataFrame, chunk: int = CHUNK, sources: int = SOURCES) -> DataFrame:
    """lang, source and, for each, its count of kept terms (n_group), the lang's terms (v), their count (n_lang), chunks, and the group's block of blocks."""
    whole = F.col("term") != ""
    langs = terms.groupBy("lang").agg(F.sum((whole & F.col("first")).cast("long")).alias("v"), F.sum("n").alias("n_lang"), F.countDistinct("source").alias("__sources"))
    groups = terms.groupBy("lang", "source").agg(F.sum("n").alias("n_group")).join(langs.hint("merge"), "lang")
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    up = lambda x, by: F.ceil(x / by).cast("int")
    return written(groups.select("lang", "source", "n_group", "v", "n_lang", up(F.col("v"), chunk).alias("chunks"), (at / sources).cast("int").alias("block"), up(F.col("__sources"), sources).alias("blocks")), "groups")


def with_groups(rows: DataFrame, groups: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """rows with their group's columns: by broadcast up to `most` groups, beyond that dealt so that a hot group is no single task's."""
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), ["lang", "source"])
    return dealt_join(rows, groups, ["lang", "source"], "inner", F.xxhash64("term"))


def top_terms(rows: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The terms that a group uses more than its language does."""
    p, q = share(F.col("n"), F.col("n_group") + F.col("v")), share(F.col("total"), F.col("n_lang") + F.col("v"))
    above = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """share() of numpy counts: long division by digits of 1,000, so that nothing leaves 64 bits."""
    rest, out = counts.astype(np.int64) + 1, np.zeros(len(counts), np.int64)
    whole, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + whole * SCALE + out


def joint_sums(counts: list[np.ndarray], ids: list[np.ndarray], totals: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For every two groups of a chunk, sums over the terms that either has: of the divergence of the row's group from the column's, and of terms.

    counts and ids: each group's nonzero counts and their term ids; totals: N + V of each group."""
    s, width = len(ids), 64 * -(-(1 + max((int(i.max()) for i in ids if len(i)), default=0)) // 64)
    level, shares_of, zero = np.zeros((s, width), np.int32), [], np.zeros(s, np.int64)
    listed, sets, owner, share_of_set = np.zeros((s, width), bool), [], [], []
    for g in range(s):
        levels, at, size = np.unique(counts[g], return_inverse=True, return_counts=True)
        level[g, ids[g]] = at + 1
        shares_of.append(shares(np.concatenate([[0], levels]), totals[g]))
        zero[g] = shares_of[g][0]
        dense = size >= width // 64
        listed[g, ids[g][~dense[at]]] = True
        for k in np.flatnonzero(dense):
            bits = np.zeros(width, bool)
            bits[ids[g][at == k]] = True
            sets.append(np.packbits(bits).view(np.uint64))
            owner.append(g)
            share_of_set.append(shares_of[g][k + 1])
    value, terms = np.zeros((s, s), np.int64), np.zeros((s, s), np.int64)
    diverge = lambda p, q: (p - q) * (p - q) // q
    for g in range(s):  # terms in a list of g; those that are in a list of an earlier group as well were taken there
        own = np.flatnonzero(listed[g])
        p = shares_of[g][level[g, own]]
        for h in range(s):
            if h != g:
                at, q = slice(None), shares_of[h][level[h, own]]
                if h < g:
                    at = ~listed[h, own]
                value[g, h] += diverge(p[at], q[at]).sum()
                value[h, g] += diverge(q[at], p[at]).sum()
                n = len(own) if h > g else int(at.sum())
                terms[g, h] += n
                terms[h, g] += n
    if sets:
        sets, share_of_set = np.stack(sets), np.array(share_of_set)
        of = np.zeros((len(owner), s), np.int64)
        of[np.arange(len(owner)), owner] = 1
        lists = np.packbits(listed, axis=1).view(np.uint64)
        for k, g in enumerate(owner):
            p = share_of_set[k]
            cell = np.bitwise_count(sets[k] & sets).sum(axis=1).astype(np.int64)
            value[g] += (cell * diverge(p, share_of_set)) @ of
            met = cell @ of
            alone = int(np.bitwise_count(sets[k]).sum()) - met - np.bitwise_count(sets[k] & lists).sum(axis=1).astype(np.int64)
            alone[g] = 0  # by complement: neither in a set nor in a list of the other
            value[g] += alone * diverge(p, zero)
            value[:, g] += alone * diverge(zero, p)
            terms[g] += met + alone
            terms[:, g] += alone
    return value, terms


SUMS = "lang string, source string, item string, value decimal(38,0), terms long"


def tile_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of one chunk for the pairs of one tile."""
    _, _, first, second = (k.as_py() for k in key)
    rows = table.to_pydict()
    split = lambda c: [np.asarray(x if x is not None else [], np.int64) for x in rows[c]]
    value, terms = joint_sums(split("counts"), split("ids"), [n + v for n, v in zip(rows["n_group"], rows["v"], strict=True)])
    block, names = rows["block"], rows["source"]
    pairs = [(g, h) for g in range(len(names)) for h in range(len(names)) if g != h and (first == second or block[g] != block[h])]
    return pa.table(
        [
            pa.array([rows["lang"][0]] * len(pairs), pa.string()), pa.array([names[g] for g, _ in pairs], pa.string()), pa.array([names[h] for _, h in pairs], pa.string()),
            pa.array([int(value[p]) for p in pairs], pa.int64()).cast(pa.decimal128(38, 0)), pa.array([int(terms[p]) for p in pairs], pa.int64()),
        ],
        ["lang", "source", "item", "value", "terms"],
    )


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The divergence of each group from every other of its language, over all kept terms."""
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).select("lang", "source", "chunk", "term", "n")
    numbered = chunked.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    cells = numbered.groupBy("lang", "chunk", "source").agg(F.collect_list(F.struct("n", "id")).alias("cells"))
    every = groups.where("v > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    every = every.join(cells.hint("merge"), ["lang", "chunk", "source"], "left")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("first"), F.greatest(j, F.col("block")).alias("second")))
    dealt = every.select("lang", "chunk", "source", "n_group", "v", "block", F.col("cells.n").alias("counts"), F.col("cells.id").alias("ids"), F.explode(tiles).alias("tile"))
    dealt = dealt.select("*", "tile.first", "tile.second").drop("tile")
    sums = dealt.groupBy("lang", "chunk", "first", "second").applyInArrow(tile_sums, SUMS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    a = groups.select("lang", "source", "v", F.col("n_group").alias("n_a"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("n_group").alias("n_b"))
    pairs = a.join(b.hint("merge"), "lang").where("source <> item").join(sums.hint("merge"), ["lang", "source", "item"], "left")
    neither = divergence(share(F.lit(0), F.col("n_a") + F.col("v")), share(F.lit(0), F.col("n_b") + F.col("v")))
    rest = (F.col("v") - F.coalesce("terms", F.lit(0))).cast("decimal(20,0)")
    value = F.when(F.col("v") == 0, F.lit(0)).otherwise((F.coalesce("value", F.lit(0)) + rest * F.when(F.col("v") > 0, neither).cast("decimal(18,0)")).cast("long"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(best))


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, chunk: int = CHUNK, sources: int = SOURCES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """lang, source, part, item, value and rank, for docs with the columns lang, source and text."""
    terms = kept_terms(docs, min_docs)
    groups = group_table(terms, chunk, sources)
    rows = with_groups(terms.where("term <> ''"), groups, most_broadcast)
    return pair_values(rows, groups).unionByName(top_terms(rows, top))


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return source_audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT row_id, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
kept AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN k USING (lang, term)),
v AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM k GROUP BY lang),
g AS (
  SELECT s.lang, s.source, coalesce((SELECT sum(n) FROM kept WHERE kept.lang = s.lang AND kept.source = s.source), 0) AS n_group, coalesce(v.v, 0) AS v, v.n_lang
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang)),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(kept.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(kept.n, 0) + 1)) // (g.n_group + g.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.total + 1)) // (g.n_lang + g.v)::HUGEINT AS q
  FROM g JOIN k USING (lang) LEFT JOIN kept ON kept.lang = g.lang AND kept.source = g.source AND kept.term = k.term),
p AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM p QUALIFY part = 'pair' OR rank <= 200
"""
