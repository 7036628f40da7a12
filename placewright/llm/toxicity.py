"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, all from the text alone: how dense, how many and how strong its lexicon words are (whole words, and
word beginnings for inflected forms), how near they stand to a second-person pronoun, its rates of capitals, of
punctuation, of digits and signs inside words and of letters repeated, and its length.

The lexicon is learned from the training rows: words and beginnings of 4 to 7 letters by their smoothed log odds between
toxic and clean texts, where these stand out from chance. A word counts only if toxic texts show it after many different words, so that a word of one
much-copied text doesn't pass for a lexicon word. Two thirds of the sample grow the lexicon and trees, the others
calibrate.

The training sample is bounded (MAX_TRAIN rows, drawn by a hash of the id), and so is what stands out in it: the lexicon, which is all that is collected and
broadcast. Scoring is one pass over the texts, without a shuffle.

Defined cases: a null text scores as an empty one. A row with a null label, or no document, doesn't train. With no training rows, or
only one label among them, every score is the share of toxic labels (0 without labels). Rows with repeated ids train
once for each. Very long texts are scored whole. An empty table gives an empty result; extra columns are
ignored, and kept by drop_toxic, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.llm.common import crc_of_id, id_share, written

MAX_TRAIN, MIN_TEXTS, MIN_WEIGHT, MIN_Z = 24_000, 3, 1.0, 3.2
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.7
TREES, DEPTH = 20, 3

TOKENS = re.compile(r"\w+(?:[@$!*+.-]\w+)*[@$*]*")
REPEATED = re.compile(r"([^\W\d_])\1\1")
# Second-person pronouns, and the letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine deinen deiner euch ihr euer tu te toi ton ta tes vous votre vos usted ustedes tus ti vosotros os".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "+": "t", ".": None, "-": None, "_": None})
NEAR = 4

FEATURES = (
    "word_density", "word_hits", "word_strength", "word_best", "start_density", "start_hits", "start_best", "start_strength", "start_repeat",
    "second_person", "near_second_person", "capitals", "capital_words", "punctuation", "exclamation", "obfuscated", "repeated", "length",
)


def tokens_of(text: str) -> tuple[list[str], int]:
    """Words in lower case with digits and signs inside them read as letters, and how many needed that."""
    words, masked = [], 0
    for w in TOKENS.findall(text.lower()):
        if not w.isalpha():
            plain = w.translate(LEET)
            if not w.isdigit() and plain.isalpha() and not w.isalpha():
                masked += 1
                w = plain
        words.append(w)
    return words, masked


def starts_of(word: str) -> list[str]:
    return [word[:n] + "-" for n in BEGINNINGS if len(word) > n]


def context_bit(word: str) -> int:
    """One of 62 bits by a word that stands before another."""
    return 1 << (sum((i + 1) * ord(c) for i, c in enumerate(word)) % 62)


def count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, toxic texts, clean texts, bits of the words before it in toxic texts), summed over each partition's batches."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, _ = tokens_of(text or "")
            bits: dict[str, int] = {}
            before = ""
            for w in words:
                bit = context_bit(before) if toxic else 0
                bits[w] = bits.get(w, 0) | bit
                for s in starts_of(w):
                    bits[s] = bits.get(s, 0) | bit
                before = w
            for item, b in bits.items():
                c = counts.setdefault(item, [0, 0, 0])
                c[0 if toxic else 1] += 1
                c[2] |= b
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), *[pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3)]], ["item", "bad", "clean", "bits"]
        )


def learn_lexicon(train: DataFrame, n_bad: int, n_clean: int) -> dict[str, float]:
    """Items with their weight: smoothed log odds of a toxic text, given that it holds the item."""
    parts = train.select("text", "toxic").mapInArrow(count_items, "item string, bad long, clean long, bits long")
    items = parts.groupBy("item").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"), F.expr("bit_count(bit_or(bits))").alias("contexts"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("clean") + 1.5) / (n_clean + 1.0))
    noise = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("clean") + 1.5))
    strong = items.withColumn("weight", odds).where((F.col("bad") >= MIN_TEXTS) & (F.col("weight") > MIN_WEIGHT) & (F.col("weight") / noise > MIN_Z))
    # copies of one text show an item after one word; a true lexicon item is seen after nearly as many as chance allows
    fresh = 62 * (1 - F.pow(F.lit(61 / 62), F.col("bad").cast("double")))
    strong = strong.where(F.col("contexts") >= 0.4 * fresh)
    return {r.item: r.weight for r in strong.select("item", "weight").collect()}


def features_of(text: str, lexicon: dict[str, float]) -> tuple[float, ...]:
    words, masked = tokens_of(text)
    n, size = max(1, len(words)), max(1, len(text))
    hits, strength, best, starts, start_best, start_strength, near, seconds = 0, 0.0, 0.0, 0, 0.0, 0.0, 0, 0
    families: dict[str, float] = {}
    last_second, last_hit = -1000, -1000
    for i, w in enumerate(words):
        if w in SECOND_PERSON:
            seconds += 1
            near += i - last_hit <= NEAR
            last_second = i
        weight = lexicon.get(w)
        begun = [s for s in starts_of(w) if s in lexicon] if len(w) > 4 else ()
        if weight is None and not begun:
            continue
        if weight is not None:
            hits += 1
            strength += weight
            best = max(best, weight)
        if begun:
            starts += 1
            strongest = max(lexicon[s] for s in begun)
            start_best = max(start_best, strongest)
            start_strength += strongest
            for s in begun:
                families[s] = families.get(s, 0.0) + lexicon[s]
        near += i - last_second <= NEAR
        last_hit = i
    upper = sum(map(str.isupper, text))
    caps = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    marks = sum(text.count(c) for c in ".,;:!?'\"()[]{}*#$%&@")
    return (
        hits / n, math.log1p(hits), strength / n, best, starts / n, math.log1p(starts), start_best, start_strength / n, max(families.values(), default=0.0) / n,
        seconds / n, near / n, upper / size, caps / n, marks / size, text.count("!") / size, masked / n, len(REPEATED.findall(text)) / n, math.log1p(n),
    )


def featured(df: DataFrame, lexicon: dict[str, float], keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and the features, as one array, of the column `text`."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    schema = df.select(*keep).schema.add("__features", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = [features_of(t or "", known) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(pa.float64()))], [*keep, "__features"])

    return df.select(*keep, "text").mapInArrow(run, schema)


class ToxicityModel:
    """A lexicon, the trees over its features and the calibration of their output."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, base: float):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def raw(self, features: DataFrame) -> DataFrame:
        scored = self.trees.transform(features.withColumn("__vector", array_to_vector("__features")))
        return scored.withColumn("__margin", vector_to_array("rawPrediction")[1])

    def score(self, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """The kept columns and score, one row for each row of df, which has the column text. No kept column is named score."""
        if self.trees is None:
            return df.select(*keep, F.lit(float(self.base)).alias("score"))
        # the kept columns travel as one, so that none of their names meets those of the model
        packed = df.select(F.struct(*[df[c] for c in keep]).alias("__kept"), df["text"].alias("text"))
        out = self.calibration.transform(self.raw(featured(packed, self.lexicon, ("__kept",))))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__calibrated")))
        return out.select(*[F.col("__kept").getField(c).alias(c) for c in keep], score.alias("score"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicityModel:
    """The model from the columns doc_id and text of documents, and doc_id and toxic of the labels that may train."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    n, bad = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == n:
        return ToxicityModel({}, None, None, bad / n if n else 0.0)
    # max_train rows at most and known before the join, so that they may be broadcast
    drawn = labels.where(id_share(F.col("__id"), 7) < 0.97 * max_train / n) if n > max_train else labels
    train = docs.select("doc_id", "text").join(F.broadcast(drawn), docs["doc_id"] == F.col("__id")).select("doc_id", "text", "toxic")
    train = written(train.repartition(max(8, min(32, n // 500)), "doc_id"), "toxic-sample").withColumn("fold", (id_share(F.col("doc_id"), 3) * 3).cast("int"))
    grow = train.where("fold < 2")
    sizes = dict(grow.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return ToxicityModel({}, None, None, bad / n)
    lexicon = learn_lexicon(grow, sizes[1], sizes[0])
    rows = featured(train, lexicon, ("doc_id", "toxic", "fold")).withColumn("label", F.col("toxic").cast("double")).cache()
    vectors = rows.withColumn("__vector", array_to_vector("__features"))
    trees = GBTClassifier(featuresCol="__vector", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=5, cacheNodeIds=False).fit(vectors.where("fold < 2"))
    model = ToxicityModel(lexicon, trees, None, bad / n)
    held = model.raw(rows.where("fold = 2")).select("__margin", "label")
    if held.limit(1).count() == 0:
        held = model.raw(rows).select("__margin", "label")
    model.calibration = IsotonicRegression(featuresCol="__margin", labelCol="label", predictionCol="__calibrated").fit(held)
    rows.unpersist()
    return model


def held_out(doc_id: Column) -> Column:
    """True for rows that must not train: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = fit(docs, labels).score(docs.withColumn("held_out", held_out(F.col("doc_id"))), ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", predicted(F.col("score")).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that are predicted toxic, in the columns of docs."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("text"))
    clean = fit(docs.select("doc_id", "text"), labels).score(rows, ("__row",)).where(predicted(F.col("score")) == 0)
    return clean.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
