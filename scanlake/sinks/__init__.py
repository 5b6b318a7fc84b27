"""Report documents and fact tables written by the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.paths import artifact_visible
from scanlake.operators.totals import COUNTERS

SCHEMA_VERSION = "1.0.0"
MAX_DOCUMENTS_PER_FILE = 10_000


def counters(prefix: str = "", upper: bool = False) -> Column:
    return F.struct(
        *[
            F.coalesce(F.col(prefix + name), F.lit(0)).cast("bigint").alias(name.upper() if upper else name)
            for name in COUNTERS
        ]
    )


def scan_summary_json(rows: DataFrame) -> DataFrame:
    """(scan_id, content): the summary document of each scan; fields without a value are left out.

    Secret detection is listed among the scans with the number found and no severity counters.
    """
    no_number, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    typed = F.transform_values(
        "findings_by_type",
        lambda _, v: F.struct(*[v[name].alias(name) for name in COUNTERS], no_number.alias("found"), no_text.alias("file")),
    )
    secret = F.struct(
        *[no_number.alias(name) for name in COUNTERS],
        F.col("secrets").alias("found"),
        F.lit("secret-scan.json").alias("file"),
    )
    entries = F.concat(
        F.coalesce(F.map_entries(typed), F.array()),
        F.when(F.col("secrets").isNotNull(), F.array(F.struct(F.lit("Secret Detection").alias("key"), secret.alias("value")))).otherwise(F.array()),
    )
    doc = F.struct(
        "scan_id",
        "scan_type",
        "gate_status",
        (F.col("gate_status") == "PASS").alias("gate_passed"),
        counters().alias("totals"),
        F.coalesce("secrets", F.lit(0)).alias("secrets_found"),
        "sbom_component_count",
        F.col("quality_gate").alias("sonarqube_quality_gate"),
        F.map_from_entries(entries).alias("findings_by_scan"),
    )
    return rows.select("scan_id", F.to_json(doc).alias("content"))


def comprehensive_summary(rows: DataFrame) -> DataFrame:
    """Counters of the comprehensive report as summary rows: misconfigurations join the totals, an empty inventory
    reads as none, and anything but PASS fails."""
    return rows.select(
        "scan_id",
        F.lit("devsecops").alias("scan_type"),
        F.when(F.col("overall_status") == "PASS", "PASS").otherwise("FAIL").alias("gate_status"),
        (F.col("critical") + F.col("misconfig_critical")).alias("critical"),
        (F.col("high") + F.col("misconfig_high")).alias("high"),
        "medium",
        "low",
        F.lit(0).cast("bigint").alias("unknown"),
        "secrets",
        F.nullif("sbom_component_count", F.lit(0)).alias("sbom_component_count"),
        "quality_gate",
        F.lit(None).cast("map<string,struct<critical:bigint,high:bigint,medium:bigint,low:bigint,unknown:bigint>>").alias("findings_by_type"),
    )


# Optional parts of the unified report: column of the rows -> field of the document.
UNIFIED_SUMMARY_PARTS = {"tool_status": "tool_status", "warnings": "warnings"}
UNIFIED_PARTS = {"generated_at": "generated_at", "project_root": "project_root", "phase_status": "phase_status", "artifacts": "artifacts"}


def unified_report_json(rows: DataFrame) -> DataFrame:
    """(scan_id, content): the nested final report of each local scan; optional parts follow the columns given."""

    def optional(parts: dict[str, str]) -> list[Column]:
        return [F.col(column).alias(field) for column, field in parts.items() if column in rows.columns]

    verdict = F.struct(F.col("status").alias("status"), "reasons", F.col("strict").alias("strict_mode"))
    tests = [F.col(f"test_{name}").alias(name) for name in ("total", "passed", "failed", "errors")]
    doc = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "scan_id",
        "mode",
        "strict",
        "adapters",
        F.struct(
            verdict.alias("gate_verdict"),
            counters(upper=True).alias("severity_totals"),
            F.struct(*tests).alias("tests"),
            F.struct(F.col("coverage_pct").alias("overall_percent"), "missing").alias("coverage"),
            *optional(UNIFIED_SUMMARY_PARTS),
        ).alias("summary"),
        F.col("by_tool").alias("findings_by_tool"),
        "traceability",
        *optional(UNIFIED_PARTS),
    )
    return rows.select("scan_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("content"))


def comprehensive_json(rows: DataFrame) -> DataFrame:
    """(scan_id, content): overall status, counters, section states, issue count, leading issues (50 at most)."""
    doc = F.struct(
        "overall_status",
        F.struct("critical", "high", "secrets", "test_failed").alias("summary"),
        "sections",
        "critical_issues_count",
        "top_issues",
    )
    return rows.select("scan_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("content"))


# Keys of a gate file, in order.
GATE_KEYS = {
    "CRITICAL_VULNS": "critical",
    "HIGH_VULNS": "high",
    "MEDIUM_VULNS": "medium",
    "LOW_VULNS": "low",
    "SECRETS": "secrets",
    "MISCONFIGS": "misconfigs",
}


def gate_results_text(rows: DataFrame, with_status: bool = True) -> DataFrame:
    """(scan_id, content): the key=value gate file; one family of scans leaves the status line out."""
    lines = [F.concat(F.lit(f"{key}="), F.col(name).cast("string")) for key, name in GATE_KEYS.items()]
    if with_status:
        lines.append(F.concat(F.lit("GATE_STATUS="), F.col("gate_status")))
    return rows.select("scan_id", F.concat_ws("\n", *lines).alias("content"))


def visible_artifacts(artifacts: DataFrame) -> DataFrame:
    """The files a reader may have, in path order per scan once written."""
    return artifacts.where(artifact_visible("rel_path"))


def write_documents(docs: DataFrame, root: str, name: str, folders: str | None = None) -> None:
    """Write one document per line below ``root/name``, optionally one folder per value of ``folders``.

    Without folders a task writes what it holds. With folders the rows are rebalanced first: large folders get
    several files of bounded size and small ones do not get a file from every task.
    """
    rows = docs.hint("rebalance", folders) if folders else docs
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", MAX_DOCUMENTS_PER_FILE)
    if folders:
        writer = writer.partitionBy(folders)
    writer.text(f"{root}/{name}")


def write_facts(facts: DataFrame, path: str, day: str = "day", cluster: tuple[str, ...] = ("kind",), tasks: int | None = None) -> None:
    """Fact table with a folder for each day, written anew for the days at hand; others stay as they are.

    A day's rows lie together, ordered by ``cluster``, so a kind is read by the statistics of row groups and a table of 2,400 small days
    is 2,400 files, not one for each day, kind and task. The rebalance hint lets adaptive execution split a large day over many tasks;
    it would give many small days to one task, which ``tasks`` spreads by ranges of (day, cluster) instead.
    """
    rows = facts.repartitionByRange(tasks, day, *cluster) if tasks else facts.hint("rebalance", day)
    rows = rows.sortWithinPartitions(day, *cluster)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
