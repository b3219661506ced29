"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)


def give_back() -> None:
    """Hands this process's free memory back to the system, where the C library can: a Python worker lives on after its task."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def values(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """A column's values one after the other; no more than ``step`` of them are Python objects at a time."""
    for k in range(0, len(column), step):
        yield from column.slice(k, step).to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set (tests, one machine)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarnfold-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, executors may go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(keys: DataFrame, label: str, name: str = "name") -> DataFrame:
    """Distinct rows with their places from 0 in the sorted order of all: a sort by range, a number inside, the counts before.

    Places follow from the rows alone, however they are partitioned; no task gathers more than a range.
    """
    spark, columns = keys.sparkSession, keys.columns
    sorted_ = keys.repartitionByRange(width(spark), *columns).sortWithinPartitions(*columns)
    placed = stage(sorted_.select(*columns, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), label)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))  # a row for each range
    return placed.join(F.broadcast(first), "__part").select(*columns, (F.col("__first") + F.col("__at")).alias(name))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


BUCKETS = 1 << 20


def keep_rows(docs: DataFrame, found: DataFrame, key: str, sha: Column) -> DataFrame:
    """The rows of ``docs`` that ``found`` (key, sha, kept) keeps; rows travel whole in a column of their own, so that no name of theirs can clash.

    Rows whose digest shares none of ``BUCKETS`` buckets with a row to drop stay where they are; only the
    others are looked up by key and digest.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    kept = found.where("kept").select(F.col(key).alias("keep_key"), F.col("sha").alias("keep_sha"))
    drop = F.broadcast(found.where("not kept").select(bucket("sha").alias("bucket")).distinct())  # BUCKETS rows at most
    marked = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), sha.alias("sha")).withColumn("bucket", bucket("sha"))
    clear, rest = marked.join(drop, "bucket", "left_anti"), marked.join(drop, "bucket", "left_semi")
    rest = rest.join(kept, F.col("key").eqNullSafe(F.col("keep_key")) & (F.col("sha") == F.col("keep_sha")), "left_semi")
    return clear.select("row.*").unionByName(rest.select("row.*"))


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
