"""What the modules of queries share: registration, rounding, and the driver's tables as samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SECOND, instant, pin_utc, samples_from

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, exact: bool = False):
    """Registers a query under its function's name, with its DuckDB statement if there is one; exact: nothing is rounded."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return fn(spark, sf_dir) if exact else rounded(fn(spark, sf_dir))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def working_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder of spark.checkpoint.dir; where that is unset, in a temporary one on a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="strideline-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_from(events(spark, sf_dir), "user_id", "ts", value="value")


def triaxial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z of embeddings, one sample a second, ten records."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = instant(F.lit(1704067200 * SECOND).cast("long") + F.col("vec_id").cast("long") * SECOND)
    return e.select((F.col("vec_id") % 10).alias("subject_id"), at.alias("ts"), *(F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")))


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_from(triaxial(spark, sf_dir), "subject_id", "ts", x="x", y="y", z="z")


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def seconds(a: str = "start_ts", b: str = "end_ts") -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1000000.0)"


def sql_bouts(low: float, high: float, source: str = "events", name: str = "bouts") -> str:
    return f"""{name}_f AS (SELECT user_id AS subject_id, ts, value BETWEEN {low} AND {high} AS f,
  coalesce(lead(ts) OVER w, ts + coalesce(ts - lag(ts) OVER w, INTERVAL 0 SECOND)) AS nxt,
  coalesce(lag(value BETWEEN {low} AND {high}) OVER w, false) AS before FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
{name}_i AS (SELECT *, sum(CASE WHEN f AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM {name}_f),
{name} AS (SELECT subject_id, min(ts) AS start_ts, max(nxt) AS end_ts FROM {name}_i WHERE f GROUP BY subject_id, run)"""


SQL_XYZ = """xyz AS (SELECT vec_id % 10 AS subject_id, TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL 1 SECOND AS ts,
  CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""
SQL_VM = "sqrt(x * x + y * y + z * z)"
