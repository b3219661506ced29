"""Markdown sections of files as they arrive, and re-indexing on arrival.

Not something the batch engine needs: a convenience on top of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnfold.functions import text as tx
from tarnfold.operators import markdown
from tarnfold.plans.engine import Engine
from tarnfold.plans.workers import ship


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """path, content of Markdown files as they appear below a folder."""
    ship(spark)
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return raw.select(tx.relative(F.input_file_name(), root).alias("path"), F.col("value").alias("content"))


def sections(spark: SparkSession, root: str) -> DataFrame:
    return markdown.sections(arriving(spark, root))


def reindexed(engine: Engine, checkpoint: str) -> StreamingQuery:
    """Runs an index pass for every batch of files that arrives."""
    return arriving(engine.spark, engine.root).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: engine.index() and None).start()
