"""Code-quality server documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlake import schemas
from scanlake.functions.rows import each


def _json(schema: str) -> Column:
    return F.from_json("content", schema, {"mode": "PERMISSIVE"})


def read_quality_gate(df: DataFrame) -> DataFrame:
    """Upper-cased status of a wrapped or bare document, empty reads null; plus its conditions."""
    doc = df.withColumn("doc", _json(schemas.QUALITY_GATE))
    wrapped = F.col("doc.projectStatus.status").isNotNull() | F.col("doc.projectStatus.conditions").isNotNull()
    status = F.when(wrapped, F.col("doc.projectStatus.status")).otherwise(F.col("doc.status"))
    return doc.select(
        "scan_id",
        "file",
        F.nullif(F.upper(status), F.lit("")).alias("status"),
        F.col("doc.projectStatus.conditions").alias("conditions"),
    )


def gate_conditions(gates: DataFrame) -> DataFrame:
    rows = each(gates, ["scan_id", "file"], "conditions", "c", "pos")
    return rows.select(
        "scan_id",
        "file",
        "pos",
        F.coalesce("c.metricKey", F.lit("")).alias("metric"),
        F.coalesce("c.actualValue", F.lit("?")).alias("actual"),
        F.coalesce("c.errorThreshold", F.lit("?")).alias("threshold"),
        F.coalesce("c.status", F.lit("?")).alias("status"),
    )


def read_measures(df: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """One column per named metric; a repeated metric takes its last value, a missing one ``N/A``."""
    doc = df.withColumn("measures", _json(schemas.MEASURES)["component"]["measures"])

    def last(metric: str) -> Column:
        hits = F.filter("measures", lambda m: m["metric"] == metric)
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit("N/A"))

    return doc.select("scan_id", "file", *[last(m).alias(m) for m in metrics])


def quality_issues(df: DataFrame) -> DataFrame:
    """One row per issue, with its place in the file."""
    rows = each(df, ["scan_id", "file"], _json(schemas.QUALITY_ISSUES)["issues"], "i", "pos")
    return rows.select("scan_id", "file", "pos", "i.*")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("scan_id").agg(
        F.count("*").alias("open_issues"),
        F.count_if(F.col("severity") == "BLOCKER").alias("blocker"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
    )


def leading_issues(issues: DataFrame, order: tuple[str, ...], n: int = 20) -> DataFrame:
    """The first ``n`` issues of each scan in file order."""
    first = W.partitionBy("scan_id").orderBy(*order)
    ranked = issues.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)
    return ranked.select(
        "scan_id",
        "rank",
        F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"),
        F.substring(F.coalesce("message", F.lit("")), 1, 150).alias("title"),
        F.concat(
            F.coalesce("component", F.lit("")), F.lit(": "), F.coalesce("rule", F.lit(""))
        ).alias("detail"),
    )
