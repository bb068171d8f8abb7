"""User functions for models: text generators, once or so that work goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import names_in


def generate(prompts: DataFrame, generator: Callable[[list[str]], list[str]], attempts: int = 2) -> DataFrame:
    """prompts: ..., prompt. Adds raw, status and attempts; a batch that fails is asked again row by row, and a
    row that fails ``attempts`` times keeps a null reply while all others go on."""
    names = prompts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", raw string, status string, attempts int"

    def one(prompt: str) -> tuple[str | None, str, int]:
        for n in range(1, attempts + 1):
            try:
                return generator([prompt])[0], "ok", n
            except Exception:  # noqa: BLE001  a user's function may fail in any way
                continue
        return None, "failed", attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["prompt"].fillna("").tolist()
            try:
                rows = [(r, "ok", 1) for r in generator(texts)] if texts else []
            except Exception:  # noqa: BLE001
                rows = [one(t) for t in texts]
            yield pdf.assign(raw=[r[0] for r in rows], status=[r[1] for r in rows], attempts=[r[2] for r in rows])[[*names, "raw", "status", "attempts"]]

    return prompts.mapInPandas(run, schema)


def generate_stored(prompts: DataFrame, generator: Callable[[list[str]], list[str]], path: str, attempts: int = 2, round_prompts: int = 10_000) -> DataFrame:
    """generate, with the replies kept in ``path`` by a digest of their prompts: equal prompts are asked once, and
    those that have a reply not again, by whatever run, table or task it was got.

    What is missing is asked in rounds of about ``round_prompts``, each of them written before the next begins: a
    run that breaks off, or a task that is tried again, repeats what it was asking in one round at most. Failed
    prompts are asked again by the next run. Null prompts are empty ones."""
    spark = prompts.sparkSession
    digest = F.sha2(F.coalesce("prompt", F.lit("")), 256)
    kind = "digest string, raw string, status string, attempts int"

    def known() -> DataFrame:
        done = [f"{path}/{n}" for n in names_in(spark, path)]
        rows = spark.read.schema(kind).parquet(*done) if done else spark.createDataFrame([], kind)
        good = F.struct((F.col("status") == "ok").alias("ok"), "attempts", "raw", "status")
        return rows.groupBy("digest").agg(F.max(good).alias("x")).select("digest", "x.raw", "x.status", "x.attempts")

    asked = prompts.select(digest.alias("digest"), F.coalesce("prompt", F.lit("")).alias("prompt")).groupBy("digest").agg(F.first("prompt").alias("prompt"))
    missing = asked.join(known().where("status = 'ok'"), "digest", "left_anti")
    rounds = -(-missing.count() // round_prompts)
    first = 1 + max([int(n.partition("=")[2]) for n in names_in(spark, path)], default=0)
    place = F.pmod(F.xxhash64("digest", F.lit(3)), F.lit(max(1, rounds)))
    missing = missing.withColumn("place", place)
    for k in range(rounds):
        generate(missing.where(F.col("place") == k).drop("place"), generator, attempts).drop("prompt").write.mode("overwrite").parquet(f"{path}/round={first + k}")
    return prompts.withColumn("digest", digest).join(known(), "digest", "left").drop("digest")
