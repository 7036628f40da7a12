"""Scores of plans and answers against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.text import fold, text_ratio

UNSCORED = ("", "unknown")
MIN_STRAY, FUZZY = 6, 0.85
#: A character of a word.
WORD = r"[\p{L}\p{N}_]"


def label_prf(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 and support; expected is a set of labels, predicted one label. Empty and unknown don't count.

    A prediction counts for its label if it is among the expected, else against it; each expected label that isn't the prediction is missed."""
    scored = lambda x: ~x.isin(*UNSCORED)
    hit = F.array_contains(expected, F.col(predicted))
    gold = df.select(F.explode(F.filter(expected, scored)).alias("label"), (F.col(predicted) == F.col("label")).alias("hit"))
    golds = gold.groupBy("label").agg(F.sum(F.col("hit").cast("long")).alias("tp"), F.sum((~F.col("hit")).cast("long")).alias("fn"), F.count(F.lit(1)).alias("support"))
    wrong = df.where(scored(F.col(predicted)) & ~F.coalesce(hit, F.lit(False))).groupBy(F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("fp"))
    both = golds.join(wrong.hint("merge"), "label", "full").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return both.select("label", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), "support")


def confusion(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(gold, predicted, n): gold is the first expected label in order; an empty prediction shows as (empty). Rows that expect nothing have no place in it."""
    gold = F.get(F.array_sort(expected), F.lit(0))
    return df.where(F.coalesce(gold, F.lit("")) != "").groupBy(gold.alias("gold"), F.coalesce(F.nullif(predicted, F.lit("")), F.lit("(empty)")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def accuracy_rollup(df: DataFrame, by: tuple[str, ...], correct: str = "correct") -> DataFrame:
    """Accuracy over all rows and by each column alone, in one pass: dimension, value, n, accuracy."""
    cells = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by])
    rows = df.select(F.explode(cells).alias("cell"), F.col(correct).cast("int").alias("__ok"))
    return rows.groupBy("cell.dimension", "cell.value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("__ok"), 6).alias("accuracy"))


def nearest_rank_pct(df: DataFrame, value: str, by: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """The value at index round(p/100 * (n-1)), halves to even, of each group's sorted values."""
    # equal values are counted first, so that a group's task reads its different values only
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(by)
    to = F.sum("__k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = counts.withColumns({"__to": to, "__n": F.sum("__k").over(w)})
    at = lambda p: F.bround(F.lit(p) / 100 * (F.col("__n") - 1), 0).cast("long")
    pick = lambda p: F.max(F.when((F.col("__to") - F.col("__k") <= at(p)) & (at(p) < F.col("__to")), F.col(value)))
    return rows.groupBy(by).agg(*[pick(p).alias(f"p{p}") for p in percents])


def agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """How often two detectors agree: both, only_first, only_second, neither, rate."""
    a, b = F.coalesce(F.col(first), F.lit(False)), F.coalesce(F.col(second), F.lit(False))
    return df.agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"),
        F.round(F.avg((a == b).cast("int")), 6).alias("rate"),
    )


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """By model: n, share of grounded answers and median latency. A failed run counts as ungrounded; a question without results is skipped."""
    rows = runs.where(F.col("n_results") > 0)
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.coalesce("grounded", F.lit(False)) & ~F.coalesce("failed", F.lit(False))).cast("int")), 6).alias("grounded_share"),
        F.round(F.percentile(F.when(~F.coalesce("failed", F.lit(False)), F.col("latency_ms")), 0.5), 6).alias("median_ms"),
    )


def bold_names(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(r"\*\*(.+?)\*\*"), F.lit(1))


def words_of(col: Column) -> Column:
    return F.regexp_extract_all(fold(col, spaces=True), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def phrase_grams(words: str, lengths: list[int]) -> Column:
    """Word sequences of the given numbers of words as one array."""
    sizes = F.array(*map(F.lit, lengths)).cast("array<int>")
    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.transform(
        F.filter(sizes, lambda k: k <= F.size(words) - i + 1), lambda k: F.array_join(F.slice(words, i, k), " "))))


def word_counts(df: DataFrame, phrase: str) -> list[int]:
    """The different numbers of words that the phrases have, a small set."""
    return sorted(r.n for r in df.where(F.col(phrase) != "").select(F.size(F.split(phrase, " ")).alias("n")).distinct().collect())


def grounding(answers: DataFrame, results: DataFrame, titles: DataFrame, exact: bool = False) -> DataFrame:
    """(answer_id, grounded). An answer is grounded if each **bold** name is close to a result title or stands in the question, and no other
    title of two words or more stands in its text. answers: answer_id, question, answer; results: answer_id, title; titles: title.

    Titles are found by joining them with the answer's word sequences of the lengths that titles have, so no answer meets every title; those found are then looked up in
    the text as they are written, marks included."""
    own = results.select("answer_id", fold(F.col("title"), spaces=True).alias("own")).where("own <> ''").distinct()
    names = answers.select("answer_id", fold(F.col("question"), spaces=True).alias("asked"), F.explode(bold_names(F.col("answer"))).alias("name"))
    names = names.select("answer_id", "asked", fold(F.col("name"), spaces=True).alias("name")).where(~F.contains("asked", F.col("name"))).drop("asked").distinct()
    pairs = names.join(own.hint("merge"), "answer_id", "left").withColumn("same", F.col("name") == F.col("own"))
    open_ = pairs.groupBy("answer_id", "name").agg(F.max(F.coalesce("same", F.lit(False))).alias("ok")).where("not ok").drop("ok")
    if not exact:  # only names that equal no title are compared letter by letter
        scored = open_.join(own.hint("merge"), "answer_id", "left").withColumn("score", text_ratio("name", "own"))
        open_ = scored.groupBy("answer_id", "name").agg(F.max("score").alias("score")).where(F.coalesce("score", F.lit(0.0)) < FUZZY)
    invented = open_.select("answer_id").distinct()
    masked = answers.join(own.groupBy("answer_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("own")).alias("n"), "own"))).alias("owns")).hint("merge"), "answer_id", "left")
    text = fold(F.replace("answer", F.lit("**"), F.lit("")), spaces=True)
    text = F.aggregate(F.coalesce("owns", F.array().cast("array<struct<n:int,own:string>>")), text, lambda t, o: F.replace(t, o["own"], F.lit(" ")))
    texts = masked.select("answer_id", fold(F.col("question"), spaces=True).alias("asked"), text.alias("text"))
    known = titles.select(fold(F.col("title"), spaces=True).alias("folded"), F.array_join(words_of(F.col("title")), " ").alias("key")).where((F.length("folded") >= MIN_STRAY) & F.contains("folded", F.lit(" "))).distinct()
    grams = texts.select("answer_id", words_of(F.col("text")).alias("words")).select("answer_id", F.explode(phrase_grams("words", word_counts(known, "key"))).alias("key")).distinct()
    # what has a title's words in a row need not have the title: it has to stand there letter by letter, between borders of words
    likely = grams.join(known.hint("shuffle_hash"), "key").join(own.withColumnRenamed("own", "folded").hint("merge"), ["answer_id", "folded"], "left_anti")
    literal = F.concat(F.lit(rf"(?<!{WORD})\Q"), F.replace("folded", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?!{WORD})"))
    stray = likely.join(texts.hint("merge"), "answer_id").where(~F.contains("asked", F.col("folded")) & F.contains("text", F.col("folded")) & F.rlike("text", literal)).select("answer_id").distinct()
    bad = invented.unionByName(stray).distinct().withColumn("__bad", F.lit(True))
    return answers.select("answer_id").join(bad.hint("merge"), "answer_id", "left").select("answer_id", F.col("__bad").isNull().alias("grounded"))
