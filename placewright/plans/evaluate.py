"""Whole evaluations: plans against labels, answers against results."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.operators import evaluation as ev


class PlanScores(NamedTuple):
    labels: DataFrame  # label_prf
    confusion: DataFrame
    accuracy: DataFrame  # over all rows, and by each column asked for
    latency: DataFrame  # nearest-rank percentiles


def golden_questions(sets: dict[str, DataFrame]) -> DataFrame:
    """The golden sets of several languages as one bag, each row with its language."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("language", F.lit(lang)) for lang, df in sets.items()])


def evaluate_plans(predictions: DataFrame, by: tuple[str, ...] = ("language",), latency: str = "latency_ms") -> PlanScores:
    """predictions: expected (a set of labels), predicted, the columns `by` and the latency. A prediction is correct if it is among the expected."""
    correct = predictions.withColumn("correct", F.coalesce(F.array_contains("expected", F.col("predicted")), F.lit(False)))
    return PlanScores(ev.label_prf(predictions), ev.confusion(predictions), ev.accuracy_rollup(correct, by), ev.nearest_rank_pct(predictions, latency, by[0]))


def evaluate_answers(answers: DataFrame, results: DataFrame, titles: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Each answer (answer_id, model, question, answer, latency_ms, failed) with grounded and its number of results, and the summary by model."""
    counts = results.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_results"))
    judged = answers.join(ev.grounding(answers, results, titles, exact).hint("merge"), "answer_id").join(counts.hint("merge"), "answer_id", "left").na.fill(0, ["n_results"])
    return judged, ev.benchmark_summary(judged)
