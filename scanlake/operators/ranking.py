"""Top-k, merged issue lists, recent builds, phase order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlake.functions.numbers import one_digit_text
from scanlake.functions.rows import keep_where
from scanlake.functions.severity import severity_rank
from scanlake.operators.skew import sliced_window

# Fixed value: no build list is longer.
BUILD_LIMIT = 100


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key. The planner keeps n rows per key in each task before the shuffle."""
    numbered = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= n)


def top_findings(findings: DataFrame, n: int = 50) -> DataFrame:
    """Worst first and in arrival order within a level, with the number of findings left out (``more``)."""
    top = first_per_key(findings, ["scan_id"], [severity_rank("severity"), F.col("ord")], n)
    sizes = findings.groupBy("scan_id").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return top.join(sizes, "scan_id")


def merge_issues(parts: list[DataFrame]) -> DataFrame:
    """One issue list from many reports; ``section`` and ``ord`` give the collection order."""
    out = None
    for section, part in enumerate(parts):
        rows = part.select(
            "scan_id", F.lit(section).alias("section"), F.col("ord").cast("bigint").alias("ord"),
            "source", "severity", "title", "detail",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def top_issues(issues: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` merged issues of a scan, numbered from 1 in collection order."""
    return first_per_key(issues, ["scan_id"], ["section", "ord"], n, rank="number")


def vulnerability_issues(findings: DataFrame) -> DataFrame:
    """CRITICAL and HIGH vulnerabilities as issues, case not folded; HIGH titles leave out the version."""
    named = F.concat("id", F.lit(": "), "package")
    with_version = F.concat(named, F.lit(" "), "installed")
    level = F.col("severity_raw")
    return findings.where((F.col("kind") == "vuln") & level.isin("CRITICAL", "HIGH")).select(
        "scan_id",
        "ord",
        F.concat(F.lit("Trivy ("), "file", F.lit(")")).alias("source"),
        level.alias("severity"),
        F.when(level == "CRITICAL", with_version).otherwise(named).alias("title"),
        F.substring("title", 1, 200).alias("detail"),
    )


def secret_issues(findings: DataFrame) -> DataFrame:
    return findings.where("kind = 'secret'").select(
        "scan_id",
        "ord",
        F.lit("Secret Detection").alias("source"),
        F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("Secret: "), "id", F.lit(": "), "package").alias("title"),
        F.concat(
            F.lit("File: "), "target", F.lit(", Line: "), F.coalesce(F.col("line").cast("string"), F.lit("?"))
        ).alias("detail"),
    )


def test_issues(failures: DataFrame) -> DataFrame:
    """Failed test cases as BLOCKER issues."""
    return failures.select(
        "scan_id", "ord", F.lit("Unit Test").alias("source"), F.lit("BLOCKER").alias("severity"), "title", "detail"
    )


def coverage_issues(coverage: DataFrame, threshold: float = 70.0) -> DataFrame:
    low = F.col("line_pct") < threshold
    return keep_where(coverage, low).select(
        "scan_id",
        "ord",
        F.lit("Coverage").alias("source"),
        F.lit("HIGH").alias("severity"),
        F.concat(
            F.lit("Coverage below threshold: "), one_digit_text("line_pct"), F.lit(f"% < {threshold}%")
        ).alias("title"),
        F.concat(F.lit("Line coverage "), "lines_covered", F.lit("/"), "lines_valid").alias("detail"),
    )


def lint_issues(items: DataFrame) -> DataFrame:
    """Dockerfile lint errors (HIGH) and warnings (MEDIUM) as issues."""
    return items.where(F.col("level").isin("error", "warning")).select(
        "scan_id",
        "ord",
        F.concat(F.lit("Hadolint ("), "file", F.lit(")")).alias("source"),
        F.when(F.col("level") == "error", "HIGH").otherwise("MEDIUM").alias("severity"),
        F.coalesce("code", F.lit("?")).alias("title"),
        F.coalesce("message", F.lit("")).alias("detail"),
    )


def quality_condition_issues(blockers: DataFrame) -> DataFrame:
    return blockers.select("scan_id", F.col("pos").alias("ord"), "source", "severity", "title", "detail")


def recent_builds(builds: DataFrame, limit: int = 10) -> DataFrame:
    """The newest builds of each job, newest first; at most 100 are given."""
    return first_per_key(builds, ["job"], [F.col("number").desc()], min(limit, BUILD_LIMIT))


def phase_timeline(phases: DataFrame, span_ms: float = 3_600_000.0) -> DataFrame:
    """Phases of a scan in start order: place, gap to the previous start, running time so far.

    Time order is cut into slices of ``span_ms``, so a scan with very many phase records still spreads.
    """
    placed = sliced_window(
        phases,
        ["scan_id"],
        ["start_ms", "phase_id"],
        F.col("start_ms"),
        span_ms,
        sums={"place": F.lit(1).cast("bigint"), "elapsed_ms": F.col("duration_ms")},
        previous={"_before": "start_ms"},
    )
    return placed.withColumn("gap_ms", F.col("start_ms") - F.col("_before")).drop("_before")


def phase_changes(chunks: DataFrame, span: float = 65536.0) -> DataFrame:
    """Chunks (build, offset, phase) whose detected phase differs from the one detected before; null phases are skipped."""
    detected = chunks.where(F.col("phase").isNotNull())
    marked = sliced_window(detected, ["build"], ["offset"], F.col("offset"), span, previous={"previous": "phase"})
    return marked.where(~F.col("phase").eqNullSafe(F.col("previous")))


def dedupe_keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key once, with the place of its first row; a plain aggregate, so copies fold before the shuffle."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def primary_language(modules: DataFrame, projects: DataFrame, default: str = "python") -> DataFrame:
    """Language of the first module by key, the root only when it is alone; ``default`` without modules."""
    is_root = F.when(F.col("module") == "root", 1).otherwise(0)
    best = modules.groupBy("project").agg(F.min_by("language", F.struct(is_root, "module")).alias("language"))
    return projects.join(best, "project", "left").select(
        "project", F.coalesce("language", F.lit(default)).alias("language")
    )


def scan_sessions(events: DataFrame, gap_seconds: int, span_seconds: float = 86_400.0) -> DataFrame:
    """(user, start_us, end_us, scans): runs of a user's scans with less than ``gap_seconds`` between two of them.

    ``events`` is (user, us, id) with ``us`` in microseconds. Gaps are looked at inside slices of time and across their ends, so a user
    with most of the scans is spread over many tasks.
    """
    place = F.col("us") / 1_000_000
    gaps = sliced_window(events, ["user"], ["us", "id"], place, span_seconds, previous={"before": "us"})
    fresh = F.coalesce((F.col("us") - F.col("before") >= gap_seconds * 1_000_000).cast("bigint"), F.lit(1))
    numbered = sliced_window(gaps.withColumn("fresh", fresh), ["user"], ["us", "id"], place, span_seconds, sums={"session": F.col("fresh")})
    return numbered.where("session is not null").groupBy("user", "session").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("scans")
    ).drop("session")
