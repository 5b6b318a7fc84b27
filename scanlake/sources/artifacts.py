"""Report files of many scans as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.schemas import CORRUPT


def read_artifacts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Whole report files below ``root/<scan>/``: (scan_id, rel_path, length, content).

    A listing that does not select ``content`` never opens the files. Line formats
    (logs, LCOV, NDJSON) are better read with :func:`read_report_lines`, which splits large files.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    scan_id, rel_path = _scan_and_path(F.col("path"), root)
    return files.select(
        scan_id.alias("scan_id"),
        rel_path.alias("rel_path"),
        "length",
        F.col("content").cast("string").alias("content"),
    )


def read_report_lines(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Lines of line-based reports below ``root/<scan>/``: (scan_id, rel_path, line)."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    scan_id, rel_path = _scan_and_path(F.col("_metadata.file_path"), root)
    return rows.select(scan_id.alias("scan_id"), rel_path.alias("rel_path"), F.col("value").alias("line"))


def stage_artifacts(artifacts: DataFrame, path: str) -> None:
    """Pack many small report files into few large Parquet files, once, before anything parses them."""
    artifacts.hint("rebalance").write.mode("overwrite").parquet(path)


def _scan_and_path(path: Column, root: str) -> tuple[Column, Column]:
    """Split ``<root>/<scan>/<relative>``; a ``key=value`` scan folder gives its value."""
    marker = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    start = F.locate(marker, path) + F.lit(len(marker))
    below = F.substring(path, start, F.length(path))
    folder = F.substring_index(below, "/", 1)
    return F.substring_index(folder, "=", -1), F.regexp_replace(below, "^[^/]+/", "")


def parse_json(df: DataFrame, schema: str, content: str = "content", out: str = "doc") -> DataFrame:
    """Parse a JSON column. Bad JSON gives a null ``out`` and ``well_formed`` false; the scan goes on."""
    parsed = F.from_json(
        F.col(content),
        f"{schema}, {CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    good = F.col("_parsed").isNotNull() & F.col(f"_parsed.{CORRUPT}").isNull()
    return (
        df.withColumn("_parsed", parsed)
        .withColumn("well_formed", good)
        .withColumn(out, F.when(good, F.col("_parsed")))
        .drop("_parsed")
    )


def non_empty_object(content: str | Column) -> Column:
    """True for text that is a JSON object with at least one key; anything else cannot be used as a source."""
    return F.coalesce(F.size(F.json_object_keys(content)) > 0, F.lit(False))
