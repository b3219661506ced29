"""Audit verdicts, JSON texts, as metrics and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions import text as tx

VERDICT = (
    "struct<perScenario:array<struct<scenarioId:string,verdict:string,score:int,evidence:array<string>>>,crossScenarioFindings:array<struct<pattern:string,scenariosAffected:array<string>,evidence:string>>,"
    "rootCauses:array<struct<issue:string,suggestedFix:struct<target:string,file:string,`change`:string>>>,notes:string>"
)


def read(rows: DataFrame, column: str = "response") -> DataFrame:
    """Rows with the verdict parsed, out of its fence if it has one; null where it is no verdict."""
    return rows.withColumn("verdict", F.from_json(tx.unfenced(F.col(column)), VERDICT))


def status(verdict: Column) -> Column:
    return F.when(verdict == "PASS", "PASS").when(verdict == "PARTIAL", "PARTIAL").when(verdict == "INFRA_FAIL", "INFRA").otherwise("FAIL")


def metrics(rows: DataFrame, key: str) -> DataFrame:
    """key, seq, name, status, detail: a metric for each scenario of each verdict."""
    each = read(rows).select(key, F.posexplode("verdict.perScenario").alias("seq", "s"))
    first = F.try_element_at(F.col("s.evidence"), F.lit(1))
    return each.select(key, "seq", F.col("s.scenarioId").alias("name"), status(F.col("s.verdict")).alias("status"), F.concat(F.lit("score="), F.coalesce("s.score", F.lit(0)).cast("string"), F.coalesce(F.concat(F.lit("; "), first), F.lit(""))).alias("detail"))


def causes(rows: DataFrame, key: str) -> DataFrame:
    each = read(rows).select(key, F.posexplode("verdict.rootCauses").alias("seq", "c"))
    return each.select(key, "seq", F.col("c.issue").alias("issue"), F.col("c.suggestedFix.target").alias("target"), F.col("c.suggestedFix.file").alias("file"))


def exit_codes(metric_rows: DataFrame, wanted: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """key, code: 1 where a scenario fails or, strictly, is not as expected."""
    bad = F.col("status").isin("FAIL", "INFRA")
    off = F.col("wanted").isNotNull() & (F.col("status") != F.col("wanted"))
    joined = metric_rows.join(wanted.select(F.col("scenario").alias("name"), "wanted"), "name", "left")
    return joined.groupBy(key).agg(F.max((bad | (F.lit(strict) & off)).cast("int")).alias("code"))
