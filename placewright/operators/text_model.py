"""Text classifiers over word and character n-grams: training rows, features, fit and scores."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewright.functions.text import fold

# Phrasings of each intent around a keyword, and those of any other label.
TEMPLATES = {
    "location": ("{kw} near me", "{kw} nearby", "{kw} close to me", "{kw} around here", "{kw} perto de mim", "{kw} perto daqui", "{kw} aqui perto", "find {kw} nearby", "closest {kw}", "{kw} proximo"),
    "popularity": ("best {kw}", "top {kw}", "most popular {kw}", "highly rated {kw}", "recommended {kw}", "melhor {kw}", "{kw} mais popular", "{kw} bem avaliado", "famous {kw}", "{kw} otimo"),
    "price": ("cheap {kw}", "affordable {kw}", "budget {kw}", "{kw} barato", "{kw} economico", "{kw} em conta", "inexpensive {kw}", "{kw} preco baixo", "low cost {kw}", "{kw} acessivel"),
    "business_hours": ("{kw} open now", "{kw} aberto agora", "is {kw} open", "{kw} open 24 hours", "{kw} aberto 24 horas", "{kw} horario de funcionamento", "when does {kw} open", "{kw} ainda aberto", "{kw} funcionando agora", "what time does {kw} close"),
    "verification": ("does {kw} exist", "is {kw} still open", "{kw} ainda existe", "is there a {kw}", "tem {kw}", "verificar {kw}", "confirmar {kw}", "check if {kw} is open", "{kw} ainda funciona", "is {kw} still there"),
}
DEFAULT_TEMPLATES = ("{kw}", "find {kw}", "show me {kw}", "I need {kw}", "looking for {kw}")
TOP, LEAST = 3, 0.2


def training_rows(keywords: DataFrame, phrases: DataFrame | None = None, negatives: DataFrame | None = None) -> DataFrame:
    """(text, label): each keyword (label, keyword) by itself and in its label's templates, then whole phrases (label, phrase), then negatives (phrase) under popularity."""
    listed = F.create_map(*[x for k, v in TEMPLATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    templates = F.concat(F.array(F.lit("{kw}")), F.coalesce(listed[F.col("label")], F.array(*map(F.lit, DEFAULT_TEMPLATES))))
    rows = keywords.select("label", "keyword", F.explode(templates).alias("t")).select(fold(F.replace("t", F.lit("{kw}"), F.col("keyword"))).alias("text"), "label")
    if phrases is not None:
        rows = rows.unionByName(phrases.select(fold(F.col("phrase")).alias("text"), "label"))
    if negatives is not None:
        rows = rows.unionByName(negatives.select(fold(F.col("phrase")).alias("text"), F.lit("popularity").alias("label")))
    return rows


def with_grams(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds words (one and two in a row) and chars (three to five letters inside a word with its bounding blanks)."""
    words = F.filter(F.split(fold(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: F.char_length(w) >= 2)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - 1, F.lit(1))), lambda i: F.array_join(F.slice("__w", i, 2), " "))
    pairs = F.when(F.size("__w") > 1, pairs).otherwise(F.array().cast("array<string>"))
    spaced = F.transform(F.split(fold(F.col(text), spaces=True), " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    chars = F.flatten(F.transform(spaced, lambda w: F.flatten(F.transform(F.array(*map(F.lit, (3, 4, 5))), lambda n: F.when(
        F.char_length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))))))
    return df.withColumn("__w", words).withColumn("words", F.concat("__w", pairs)).withColumn("chars", chars).drop("__w")


def train_text_model(rows: DataFrame, n_words: int = 500, n_chars: int = 1000, iterations: int = 500) -> PipelineModel:
    """Multinomial logistic regression on smoothed TF-IDF of the most frequent n-grams, with balanced weights.

    Only the fitted vocabulary and weights (bounded by the caps) reach the driver."""
    # as many parts as there are cores, not as many as the files have from which a small sample was drawn: each iteration has a task for each
    grams = with_grams(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)).cache()
    n = grams.count()
    stages, parts = [StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc")], []
    for name, size in (("words", n_words), ("chars", n_chars)):
        counts = CountVectorizer(inputCol=name, outputCol=f"{name}_tf", vocabSize=size).fit(grams)
        idf = IDF(inputCol=f"{name}_tf", outputCol=f"{name}_idf").fit(counts.transform(grams))
        # the usual smooth inverse frequency is this one plus 1
        scale = ElementwiseProduct(scalingVec=Vectors.dense([float(x) + 1 for x in idf.idf]), inputCol=f"{name}_tf", outputCol=f"{name}_w")
        stages += [counts, scale, Normalizer(inputCol=f"{name}_w", outputCol=f"{name}_v")]
        parts.append(f"{name}_v")
    labels = grams.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    k = labels.count()
    weighted = grams.join(F.broadcast(labels), "label").withColumn("weight", F.lit(float(n)) / (F.lit(float(k)) * F.col("__n"))).drop("__n")
    stages += [
        VectorAssembler(inputCols=parts, outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight", maxIter=iterations, regParam=1.0 / n, standardization=False, family="multinomial"),
    ]
    model = Pipeline(stages=stages).fit(weighted)
    grams.unpersist()
    return model


BLANKS = " \t\n\x0b\f\r"


def gram_steps(grams: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams as a table of steps: the column of each character (by code point; 0 for all that occur in none; blanks are one), the place that each place leads to by each column
    (place 0: no n-gram begins so; 1: the start), and the n-gram that ends at each place, or len(grams)."""
    letters = {c: i for i, c in enumerate(sorted({c for g in grams for c in g}), 1)}
    column = np.zeros(max(map(ord, [*letters, *BLANKS])) + 2, np.int32)
    for c, i in letters.items():
        column[ord(c)] = i
    if " " in letters:
        column[list(map(ord, BLANKS))] = letters[" "]
    width, ends, places = len(letters) + 1, {}, {"": 1}
    for i, g in enumerate(grams):
        for n in range(1, len(g) + 1):
            places.setdefault(g[:n], len(places) + 1)
        ends[places[g]] = i
    steps = np.zeros((len(places) + 1, width), np.int32)
    for g, at in places.items():
        if g:
            steps[places[g[:-1]], letters[g[-1]]] = at
    return column, steps, np.array([ends.get(i, len(grams)) for i in range(len(steps))], np.int32)


class GramScorer:
    """Label probabilities of folded texts by a fitted model's n-grams and weights, as its stages give them. A text's character n-grams are found by arrays, from all of its
    characters at once, in pieces of PIECE."""

    WORDS, SIZES, PIECE = re.compile(r"\w{2,}"), (3, 4, 5), 1 << 20

    def __init__(self, model: PipelineModel):
        _, words, word_scale, _, chars, char_scale, _, _, fit = model.stages
        self.singles = {x: i for i, x in enumerate(words.vocabulary) if " " not in x}
        self.pairs = {tuple(x.split(" ")): i for i, x in enumerate(words.vocabulary) if " " in x}
        self.firsts = {a for a, _ in self.pairs}
        self.column, self.steps, self.ends = gram_steps(chars.vocabulary)
        self.scales = [s.getScalingVec().toArray() for s in (word_scale, char_scale)]
        weights, n = fit.coefficientMatrix.toArray(), len(words.vocabulary)
        self.weights, self.intercept = (weights[:, :n], weights[:, n:]), fit.interceptVector.toArray()

    def inside(self, text: str) -> np.ndarray:
        """How often each character n-gram stands in the words of a text with their bounding blanks: no n-gram has blanks elsewhere, so windows across words don't count."""
        points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.zeros(len(self.scales[1]) + 1, np.int64)
        longest = max(self.SIZES)
        for start in range(0, len(points), self.PIECE):
            columns = self.column[np.minimum(points[start : start + self.PIECE + longest - 1], len(self.column) - 1)]
            at = np.ones(min(self.PIECE, len(points) - start), np.int32)
            for n in range(1, longest + 1):
                at = at[: len(columns) - n + 1]  # windows that end with the text
                at = self.steps[at, columns[n - 1 : n - 1 + len(at)]]
                if n in self.SIZES:
                    found += np.bincount(self.ends[at], minlength=len(found))
        return found[:-1]

    def probabilities(self, text: str | None) -> list[float]:
        text = text or ""
        counts = [np.zeros(len(s)) for s in self.scales]
        words = self.WORDS.findall(text)
        often = Counter(words)
        for w in self.singles.keys() & often.keys():
            counts[0][self.singles[w]] = often[w]
        for p in zip(words, words[1:]):
            if p[0] in self.firsts and (i := self.pairs.get(p)) is not None:
                counts[0][i] += 1
        counts[1][:] = self.inside(text)
        margins = self.intercept.copy()
        for x, scale, weights in zip(counts, self.scales, self.weights):
            x = x * scale
            margins += weights @ (x / (np.linalg.norm(x) or 1.0))
        if math.isinf(most := margins.max()):  # one label only
            return [float(m == most) for m in margins]
        e = np.exp(margins - most)
        return (e / e.sum()).tolist()


#: What a message is said to be when no label reaches the least probability: an intent, or a category.
NO_INTENT, NO_CATEGORY = ("unknown", 0.0), ("restaurant", 0.5)


def score_text(df: DataFrame, model: PipelineModel, text: str = "text", otherwise: tuple[str, float] = NO_INTENT, least: float = LEAST) -> DataFrame:
    """The rows with scored (up to three labels of probability `least` or more, best first), primary and confidence; where there is none, `otherwise`.
    Whole texts are read; a null text counts as an empty one."""
    labels, scorer = model.stages[0].labels, GramScorer(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([scorer.probabilities(t) for t in batch])

    out = df.withColumn("__p", probabilities(fold(F.col(text))))
    names = F.array(*map(F.lit, labels))
    pairs = F.transform(F.arrays_zip(F.col("__p").alias("p"), names.alias("l")), lambda x: F.struct((-x["p"]).alias("neg"), x["l"].alias("label")))
    top = F.slice(F.array_sort(F.filter(pairs, lambda x: -x["neg"] >= least)), 1, TOP)
    top = F.when(F.size(top) > 0, top).otherwise(F.array(F.struct(F.lit(-otherwise[1]).alias("neg"), F.lit(otherwise[0]).alias("label"))))
    out = out.withColumn("__top", top)
    first = F.get("__top", F.lit(0))
    return out.select(
        *df.columns, F.transform("__top", lambda x: F.struct(x["label"].alias("label"), F.round(-x["neg"], 6).alias("confidence"))).alias("scored"),
        first["label"].alias("primary"), (-first["neg"]).alias("confidence"),
    )
