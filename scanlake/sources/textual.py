"""Key=value files, text reports, agent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake import schemas
from scanlake.functions.rows import each, each_struct

# Labels in front of the totals of a text report.
REPORT_TOTALS = {
    "critical": "CRITICAL Vulnerabilities",
    "high": "HIGH Vulnerabilities",
    "medium": "MEDIUM Vulnerabilities",
    "secrets": "Secrets Detected",
    "misconfigs": "Misconfigurations",
}


def key_value_entries(text: Column) -> Column:
    """Array of (key, value); the first ``=`` splits, both sides are trimmed, other lines are dropped."""
    with_sign = F.filter(F.split(text, r"\r?\n"), lambda line: line.contains("="))
    return F.transform(
        with_sign,
        lambda line: F.struct(
            F.trim(F.substring_index(line, "=", 1)).alias("key"),
            F.trim(F.regexp_replace(line, "^[^=]*=", "")).alias("value"),
        ),
    )


def last_value(entries: Column, key: str) -> Column:
    """The last value of a key, null where it is missing."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def last_of_each(df: DataFrame, entries: Column, out: str) -> DataFrame:
    """``out``: the (key, value) pairs of a row, of equal keys only the last one. Sorted in the row, not shuffled."""
    placed = F.transform(
        entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("place"), e["value"].alias("value"))
    )
    rows = df.withColumn("_sorted", F.sort_array(placed))
    is_last = F.filter("_sorted", lambda e, i: ~e["key"].eqNullSafe(F.get("_sorted", i + 1)["key"]))
    return rows.withColumn(
        out, F.transform(is_last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    ).drop("_sorted")


def parse_key_values(df: DataFrame) -> DataFrame:
    """(scan_id, file, key, value); the last of repeated keys wins."""
    rows = last_of_each(df, key_value_entries(F.col("content")), "_entries")
    return each_struct(rows, ["scan_id", "file"], "_entries")


def grep_report_totals(df: DataFrame) -> DataFrame:
    """Totals recovered from a text report; 0 where a label is missing."""

    def total(label: str) -> Column:
        return F.coalesce(F.regexp_extract("content", rf"{label}.*?(\d+)", 1).try_cast("bigint"), F.lit(0))

    return df.select("scan_id", *[total(label).alias(name) for name, label in REPORT_TOTALS.items()])


def parse_agent_list(df: DataFrame) -> DataFrame:
    """Lines ``scan-agent-<id> ONLINE|OFFLINE``; all other lines are dropped."""
    rows = each(df, [], F.split("content", "\n"), "line").select(F.trim("line").alias("line"))
    parts = F.split("line", r"\s+")
    return rows.where(F.col("line").startswith("scan-agent-")).select(
        parts[0].alias("name"),
        F.coalesce(F.upper(F.try_element_at(parts, F.lit(2))) == "ONLINE", F.lit(False)).alias("online"),
    )


def scan_summary_fields(doc: Column) -> list[Column]:
    """Fields of a parsed pipeline summary."""
    # Entries without a critical counter (secret detection) are not finding types.
    types = F.map_filter(doc["findings_by_scan"], lambda _, v: v["critical"].isNotNull())
    return [
        F.coalesce(doc["gate_passed"], F.lit(True)).alias("gate_passed"),
        *[F.coalesce(doc["totals"][level], F.lit(0)).alias(level) for level in _LEVELS],
        types.alias("findings_by_type"),
        doc["sbom_component_count"].alias("sbom_component_count"),
        F.coalesce(doc["secrets_found"], F.lit(0)).alias("secrets_found"),
        doc["sonarqube_quality_gate"].alias("quality_gate"),
    ]


def unified_report_fields(doc: Column) -> list[Column]:
    """Fields of a parsed local-scan report."""
    severity = doc["summary"]["severity_totals"]
    tool = F.try_element_at(doc["summary"]["tool_status"], F.lit("sonar-scanner"))
    return [
        F.coalesce(doc["summary"]["gate_verdict"]["status"] == "PASS", F.lit(False)).alias("gate_passed"),
        *[
            F.coalesce(F.try_element_at(severity, F.lit(level.upper())), F.lit(0)).alias(level)
            for level in _LEVELS
        ],
        doc["findings_by_tool"].alias("findings_by_type"),
        F.lit(None).cast("bigint").alias("sbom_component_count"),
        F.lit(None).cast("bigint").alias("secrets_found"),
        F.when(tool["available"], "AVAILABLE").when(tool.isNotNull(), "UNAVAILABLE").alias("quality_gate"),
    ]


def read_scan_summary(df: DataFrame) -> DataFrame:
    """Pipeline summaries written earlier, re-read as a source."""
    doc = df.withColumn("doc", F.from_json("content", schemas.SCAN_SUMMARY, {"mode": "PERMISSIVE"}))
    return doc.select("scan_id", *scan_summary_fields(F.col("doc")))


def read_unified_report(df: DataFrame) -> DataFrame:
    """Local-scan reports written earlier, re-read as a source."""
    doc = df.withColumn("doc", F.from_json("content", schemas.UNIFIED_REPORT, {"mode": "PERMISSIVE"}))
    return doc.select("scan_id", *unified_report_fields(F.col("doc")))


_LEVELS = ("critical", "high", "medium", "low", "unknown")
