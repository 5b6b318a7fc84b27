"""Linter reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake import schemas
from scanlake.functions.rows import each
from scanlake.functions.text import line_count


def _records(schema: str):
    return F.from_json("content", schema, {"mode": "PERMISSIVE"})


def _count(items, keep):
    return F.size(F.filter(items, keep)).cast("bigint")


def _sum(rows: DataFrame, *names: str) -> DataFrame:
    """Files of a scan are counted one by one and then added up."""
    return rows.groupBy("scan_id").agg(*[F.sum(name).alias(name) for name in names])


def read_shellcheck(df: DataFrame) -> DataFrame:
    parsed = df.withColumn("items", F.coalesce(_records(schemas.SHELL_LINT), F.array()))
    rows = parsed.select(
        "scan_id",
        F.size("items").cast("bigint").alias("total"),
        _count("items", lambda i: i["level"] == "error").alias("errors"),
        _count("items", lambda i: i["level"] == "warning").alias("warnings"),
    )
    return _sum(rows, "total", "errors", "warnings")


def hadolint_items(df: DataFrame) -> DataFrame:
    """One row per entry; files may wrap their list in one more list."""
    nested = F.col("content").rlike(r"^\s*\[\s*\[")
    items = F.when(nested, F.flatten(_records(f"array<{schemas.DOCKER_LINT}>"))).otherwise(
        _records(schemas.DOCKER_LINT)
    )
    return each(df, ["scan_id", "file"], items, "i", "pos").select(
        "scan_id", "file", "pos", "i.level", "i.code", "i.message",
        F.col("i.file").alias("dockerfile"), F.col("i.line").try_cast("double").try_cast("int").alias("line"),
    )


def read_hadolint(df: DataFrame) -> DataFrame:
    """All entries count; only errors (HIGH) and warnings (MEDIUM) become issues."""
    return (
        hadolint_items(df)
        .groupBy("scan_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("level") == "error").alias("high"),
            F.count_if(F.col("level") == "warning").alias("medium"),
        )
    )


def read_grype(df: DataFrame) -> DataFrame:
    """(scan_id, severity, n); severities are kept as written, absent ones read ``Unknown``."""
    doc = F.from_json("content", schemas.MATCH_REPORT, {"mode": "PERMISSIVE"})
    rows = each(df, ["scan_id"], doc["matches"], "m")
    severity = F.coalesce(F.col("m.vulnerability.severity"), F.lit("Unknown"))
    return rows.groupBy("scan_id", severity.alias("severity")).agg(F.count("*").alias("n"))


def read_bandit(df: DataFrame) -> DataFrame:
    doc = F.from_json("content", schemas.PY_LINT, {"mode": "PERMISSIVE"})
    parsed = df.withColumn("items", F.coalesce(doc["results"], F.array()))
    rows = parsed.select(
        "scan_id",
        F.size("items").cast("bigint").alias("total"),
        _count("items", lambda i: i["issue_severity"] == "HIGH").alias("high"),
        _count("items", lambda i: i["issue_severity"] == "MEDIUM").alias("medium"),
    )
    return _sum(rows, "total", "high", "medium")


def read_eslint(df: DataFrame) -> DataFrame:
    parsed = df.withColumn("items", F.coalesce(_records(schemas.JS_LINT), F.array()))

    def added(field):
        zero = F.lit(0).cast("bigint")
        return F.aggregate("items", zero, lambda acc, i: acc + F.coalesce(i[field], F.lit(0)))

    rows = parsed.select("scan_id", added("errorCount").alias("errors"), added("warningCount").alias("warnings"))
    return _sum(rows, "errors", "warnings")


def count_text_issues(df: DataFrame, blank: bool = True) -> DataFrame:
    """Line-per-issue linters: every line (``blank``), or only the lines that are not blank."""
    rows = df.select("scan_id", line_count("content", blank).alias("issues"))
    return _sum(rows, "issues")


def extract_score(df: DataFrame, prefix: str = "") -> DataFrame:
    """The number after ``rated at``; null where there is none."""
    found = F.nullif(F.regexp_extract("content", prefix + r"rated at ([0-9.]+)", 1), F.lit(""))
    return df.withColumn("score", found.try_cast("double"))


def lint_as_low(df: DataFrame) -> DataFrame:
    """Every entry of a shell or Dockerfile lint list counts as one LOW finding: (scan_id, tool, low)."""
    items = _records(schemas.SHELL_LINT)
    rows = df.select("scan_id", "tool", F.coalesce(F.size(items), F.lit(0)).cast("bigint").alias("low"))
    # Filtered after the sum: before it, the filter would parse every list once more.
    return rows.groupBy("scan_id", "tool").agg(F.sum("low").alias("low")).where(F.col("low") > 0)
