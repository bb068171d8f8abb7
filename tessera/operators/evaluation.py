"""Text metrics and evaluation runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X


def distinct_n(text: Column, n: int = 2) -> Column:
    return X.bound(X.ngrams(text, n), lambda g: F.when(F.size(g) > 0, F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0))


def repetition_n(text: Column, n: int = 2) -> Column:
    """n-grams that occur more than once, counted once each, by all n-grams."""
    once = lambda g: F.size(F.array_distinct(g))
    # in the sorted list, a run's second member marks it as repeated
    repeats = lambda s: F.size(F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
    return X.bound(F.sort_array(X.ngrams(text, n)), lambda s: F.when(F.size(s) > 0, F.when(once(s) == F.size(s), 0.0).otherwise(repeats(s) / F.size(s))).otherwise(0.0))


METRICS: dict[str, Callable[[Column], Column]] = {"distinct_2": distinct_n, "repetition_2": repetition_n, "score": X.score_parse}


def run(tasks: DataFrame, responses: DataFrame, metrics: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """tasks: task_id, metric (array); responses: task_id, pipeline, response. Long form with a score; a failed response is ""."""
    rows = tasks.select("task_id", F.explode("metric").alias("metric")).join(responses, "task_id").withColumn("response", F.coalesce("response", F.lit("")))
    score = F.lit(None).cast("double")
    for name, f in (metrics or METRICS).items():
        score = F.when(F.col("metric") == name, f(F.col("response"))).otherwise(score)
    return rows.select("task_id", "pipeline", "metric", score.alias("score"))


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("pipeline", "metric").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))
