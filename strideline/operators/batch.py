"""Jobs over many records: shards, a result cache, guarded runs and post-processing of result tables."""

from __future__ import annotations

import hashlib
import json
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Keys that bounds of ranges are taken from.
BOUND_KEYS = 10_000


def shards(jobs: DataFrame, key: str, count: int) -> DataFrame:
    """key and the contiguous shard, from 1, that each job belongs to; the first shards get the remainder.

    Ranks are exact and no task sorts all jobs: bounds from keys picked by hash cut them into ranges, whose sizes say where
    each one's ranks begin. Bounds are literals, so every run of the plan makes the same ranges. Null keys come first.
    """
    spark = jobs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = jobs.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(BOUND_KEYS).orderBy(key).collect()
    bounds = [some[i][0] for i in sorted({len(some) * k // parts for k in range(1, parts)})] if some else []
    kind = jobs.schema[key].dataType
    part = F.size(F.filter(F.array(*(F.lit(b).cast(kind) for b in bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    rows = jobs.select(F.col(key), part.alias("part"))
    sizes = sorted(rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a range
    before, total = [], 0
    for r in sizes:
        before.append((r.part, total))
        total += r.n
    base, extra = divmod(total, count)
    offsets = spark.createDataFrame(before or [(0, 0)], "part int, start long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1).join(F.broadcast(offsets), "part")
    rank, large = F.col("rank") + F.col("start"), extra * (base + 1)
    shard = F.when(rank < large, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - large) / max(1, base)))
    return ranked.select(key, (shard + 1).cast("int").alias("shard"))


def shard_jobs(jobs: DataFrame, key: str, number: int, count: int) -> DataFrame:
    """The jobs of shard number, from 1, of count."""
    return jobs.join(shards(jobs, key, count).where(F.col("shard") == number).select(key), key, "left_semi")


def run_batch(jobs: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, folder: str, number: int = 1, count: int = 1, steps: int = 1) -> DataFrame:
    """Runs fn on every job of a shard, in so many steps, and keeps results, errors and progress under a folder.

    Returns the progress: a row a step with the shard, the jobs of the step, those that failed, and whether the shard is
    complete. feedback() reads it meanwhile. A failed job doesn't stop the others.
    """
    spark = jobs.sparkSession
    mine = shard_jobs(jobs, key, number, count)
    placed = mine.join(shards(mine, key, steps), key)
    for step in range(1, steps + 1):
        out = f"{folder}/results/shard={number}/step={step}"
        run_guarded(placed.where(F.col("shard") == step).drop("shard"), key, fn, schema).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out).agg(F.count_distinct(key).alias("jobs"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col(key))).alias("failed"))
        state = done.select(F.lit(number).alias("shard"), F.lit(step).alias("step"), "jobs", "failed", F.lit(step == steps).alias("complete"))
        state.write.mode("overwrite" if step == 1 else "append").json(f"{folder}/feedback/{number}")
    return feedback(spark, folder, number)


def feedback(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Progress of a shard so far."""
    return spark.read.schema("shard int, step int, jobs long, failed long, complete boolean").json(f"{folder}/feedback/{number}")


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The job list: a CSV file with a header; all columns are strings, the first one is the job's id."""
    return spark.read.csv(path, header=True)


def run_guarded(rows: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn on each job's rows; a job that fails gives one row with its key and error, and doesn't stop the others.

    Jobs are dealt to a fixed number of tasks: their rows say nothing about their work, so few bytes mustn't make one task.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = [c.split()[0] for c in schema.split(", ")]

    def guarded(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return fn(pdf).assign(error=None)[[*names, "error"]]
        except Exception:
            return pd.DataFrame([{n: pdf[n].iloc[0] if n == key else None for n in names} | {"error": traceback.format_exc(limit=1)}])

    return rows.repartition(tasks, key).groupBy(key).applyInPandas(guarded, f"{schema}, error string")


def consolidate(spark: SparkSession, pattern: str) -> DataFrame:
    """All shards of a result in one table; columns from their headers."""
    return spark.read.csv(pattern, header=True)


def proportions(results: DataFrame, columns: list[str], of: str) -> DataFrame:
    """The columns as shares of another, null where that is 0."""
    return results.withColumns({c: F.col(c) / F.nullif(F.col(of), F.lit(0.0)) for c in columns})


def write_rows(results: DataFrame, path: str, empty: float = -1) -> None:
    """Appends result rows to CSV files with a header, nulls as empty."""
    results.na.fill(empty).write.mode("append").csv(path, header=True)


class ResultCache:
    """Results by function and parameters as Parquet tables under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str, parameters: dict) -> str:
        key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:24]
        return f"{self.folder}/{name}/{key}"

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def __contains__(self, key: tuple[str, dict]) -> bool:
        fs, path = self._fs(self._path(*key) + "/_SUCCESS")
        return fs.exists(path)

    def get(self, fn: Callable[..., DataFrame], name: str, parameters: dict) -> DataFrame:
        """The stored result, or fn(**parameters), stored."""
        path = self._path(name, parameters)
        if (name, parameters) not in self:
            fn(**parameters).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def names(self) -> list[str]:
        fs, path = self._fs(self.folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def delete(self, name: str) -> None:
        fs, path = self._fs(f"{self.folder}/{name}")
        fs.delete(path, True)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names())
