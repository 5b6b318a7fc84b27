"""Counters over findings, tests, coverage and inventories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.numbers import one_digit
from scanlake.functions.severity import LEVELS, normalize_severity

COUNTERS = tuple(level.lower() for level in LEVELS)


@dataclass(frozen=True)
class Policy:
    """What a report family counts. Kinds outside ``counted`` have their own numbers."""

    counted: tuple[str, ...]
    levels: tuple[str, ...] = LEVELS
    fold: bool = True
    secret_default: str = "UNKNOWN"


# The counting policies in use; they disagree on purpose.
POLICIES = {
    "api": Policy(("vuln", "misconfig")),
    "unified": Policy(("vuln", "misconfig", "secret"), secret_default="HIGH"),
    "summary": Policy(("vuln", "misconfig")),
    "gate": Policy(("vuln",), levels=("CRITICAL", "HIGH", "MEDIUM", "LOW")),
    "gate_strict": Policy(("vuln",), levels=("CRITICAL", "HIGH"), fold=False),
    "critical_only": Policy(("vuln",), levels=("CRITICAL",), fold=False),
    "comprehensive": Policy(("vuln",), levels=("CRITICAL", "HIGH"), fold=False),
}


def _level(policy: Policy) -> Column:
    plain = normalize_severity("severity_raw", fold=policy.fold)
    if policy.secret_default == "UNKNOWN":
        return plain
    secret = normalize_severity("severity_raw", default=policy.secret_default, fold=policy.fold)
    return F.when(F.col("kind") == "secret", secret).otherwise(plain)


def severity_totals(findings: DataFrame, by: tuple[str, ...] = ("scan_id",), policy: str = "api") -> DataFrame:
    """Five counters, the secrets and the CRITICAL/HIGH misconfigurations per group, in one aggregation.

    ``findings`` has ``kind`` and ``severity_raw``. Levels the policy does not count are 0.
    """
    p = POLICIES[policy]
    leveled = findings.select(
        *by, "kind", _level(p).alias("_level"), normalize_severity("severity_raw", fold=p.fold).alias("_own")
    )
    counted = f"kind in ({', '.join(repr(kind) for kind in p.counted)})"
    counters = [
        F.expr(f"count_if({counted} and _level = '{name}')" if name in p.levels else "0L").alias(name.lower())
        for name in LEVELS
    ]
    return leveled.groupBy(*by).agg(
        *counters,
        F.expr("count_if(kind = 'secret')").alias("secrets"),
        F.expr("count_if(kind = 'misconfig' and _own = 'CRITICAL')").alias("misconfig_critical"),
        F.expr("count_if(kind = 'misconfig' and _own = 'HIGH')").alias("misconfig_high"),
    )


def with_group_total(counts: DataFrame, scan: str, part: str, sums: tuple[str, ...], label: str = "TOTAL") -> DataFrame:
    """Rows per (scan, part) and a row per scan; ``counts`` is already small, so the second pass is cheap."""
    grouped = counts.groupingSets([[scan, part], [scan]], scan, part).agg(
        *[F.sum(name).alias(name) for name in sums], F.grouping(part).alias("_g")
    )
    return grouped.withColumn(part, F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(part))).drop("_g")


def totals_by_type(findings: DataFrame, low_entries: DataFrame | None = None) -> DataFrame:
    """Counters per scan and report type, and per scan; secrets stay out.

    ``low_entries`` (scan_id, tool, low) adds linter entries as LOW findings of their own type.
    """
    counts = severity_totals(findings.where("kind <> 'secret'"), ("scan_id", "report"), "api").select(
        "scan_id", "report", *COUNTERS
    )
    if low_entries is not None:
        zero = F.lit(0).cast("bigint")
        lint = low_entries.select(
            "scan_id",
            F.col("tool").alias("report"),
            *[(F.col("low") if name == "low" else zero).alias(name) for name in COUNTERS],
        )
        counts = counts.unionByName(lint)
    return with_group_total(counts, "scan_id", "report", COUNTERS)


def totals_by_tool(findings: DataFrame) -> DataFrame:
    """Counters per scan and tool, and per scan; secrets count, HIGH unless they say otherwise."""
    counts = severity_totals(findings, ("scan_id", "tool"), "unified").select("scan_id", "tool", *COUNTERS)
    return with_group_total(counts, "scan_id", "tool", COUNTERS)


def count_secrets(reports: DataFrame) -> DataFrame:
    """Secrets per scan, added up inside each parsed report before the shuffle."""
    per_file = F.aggregate(
        F.coalesce("doc.Results", F.array()),
        F.lit(0).cast("bigint"),
        lambda acc, r: acc + F.coalesce(F.size(r["Secrets"]), F.lit(0)),
    )
    return reports.groupBy("scan_id").agg(F.sum(per_file).alias("secrets"))


def misconfig_high_count(findings: DataFrame, fold: bool = True) -> DataFrame:
    level = normalize_severity("severity_raw", fold=fold)
    hit = (F.col("kind") == "misconfig") & level.isin("CRITICAL", "HIGH")
    return findings.groupBy("scan_id").agg(F.count_if(hit).alias("misconfigs"))


def image_scan_summary(findings: DataFrame, status: Column, total_status: Column) -> DataFrame:
    """CRITICAL and HIGH vulnerabilities per image, then a TOTAL row; case is not folded."""
    counts = severity_totals(findings, ("image",), "gate_strict").select("image", "critical", "high")
    rows = counts.select("image", F.lit(1).cast("bigint").alias("images"), "critical", "high", status.alias("status"))
    total = counts.agg(
        F.lit("TOTAL").alias("image"),
        F.count("*").alias("images"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
    ).withColumn("status", total_status)
    return rows.unionByName(total)


def sbom_type_histogram(components: DataFrame) -> DataFrame:
    kind = F.coalesce("type", F.lit("unknown"))
    return components.where("has_component").groupBy("scan_id", kind.alias("type")).agg(F.count("*").alias("n"))


#: log2 of the registers of a distinct-count sketch; an estimate is off by 1.04 / 2**6 = 1.6 % (one standard deviation).
SKETCH_BITS = 12


def component_counts(components: DataFrame, partitions: int | None = None) -> DataFrame:
    """(scan_id, purl, n) from component rows. ``partitions`` is for inputs too large for the session's number of shuffle partitions."""
    keys = ("scan_id", "purl")
    return (components.repartition(partitions, *keys) if partitions else components).groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_components(components: DataFrame, partitions: int | None = None) -> DataFrame:
    """(scan_id, components, distinct_components, sketch) from component rows with ``purl``.

    The count is exact for each scan; the sketch is what windows and groups of scans are merged from without reading components again.
    Components without a purl are not distinct ones.
    """
    return components_of_scans(component_counts(components, partitions), partitions)


def components_of_scans(counts: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same from (scan_id, purl, n), each pair once."""
    return (counts.repartition(partitions, "scan_id") if partitions else counts).groupBy("scan_id").agg(
        F.sum("n").alias("components"), F.count("purl").alias("distinct_components"), F.hll_sketch_agg("purl", SKETCH_BITS).alias("sketch")
    )


def merged_components(scans: DataFrame, by: str) -> DataFrame:
    """(by, scans, distinct_estimate) over stored sketches."""
    return scans.groupBy(by).agg(F.count("*").alias("scans"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))


def sbom_totals(file_counts: DataFrame) -> DataFrame:
    """Components added over the inventories of a scan, and the number of inventory files."""
    return file_counts.groupBy("scan_id").agg(
        F.coalesce(F.sum("components"), F.lit(0)).alias("components"), F.count("*").alias("sbom_files")
    )


def test_totals(junit: DataFrame) -> DataFrame:
    """Per framework and over all; passed is never negative, file by file."""
    passed = F.greatest(F.col("tests") - F.col("failures") - F.col("errors") - F.col("skipped"), F.lit(0))
    counts = junit.groupBy("scan_id", "framework").agg(
        F.sum("tests").alias("total"),
        F.sum("failures").alias("failed"),
        F.sum("errors").alias("errors"),
        F.sum(passed).alias("passed"),
    )
    return with_group_total(counts, "scan_id", "framework", ("total", "failed", "errors", "passed"), "ALL")


def test_totals_report(junit: DataFrame, variant: str = "pytest") -> DataFrame:
    """Report counters: ``pytest`` may go below zero; ``junit`` ignores skips and leaves errors out of its sum."""
    skipped = F.col("skipped") if variant == "pytest" else F.lit(0)
    passed = F.col("tests") - F.col("errors") - F.col("failures") - skipped
    errors = F.col("errors") if variant == "pytest" else F.lit(0).cast("bigint")
    return junit.groupBy("scan_id").agg(
        F.sum("tests").alias("test_total"),
        F.sum(passed).alias("test_passed"),
        F.sum("failures").alias("test_failed"),
        F.sum(errors).alias("test_errors"),
        (F.sum("errors") > 0).alias("any_error"),
    )


def coverage_overall(coverage: DataFrame) -> DataFrame:
    """Unweighted mean over the adapters that have a value; null where none has."""
    return coverage.groupBy("scan_id").agg(one_digit(F.avg("line_pct")).alias("coverage_pct"))


def coverage_missing(adapters: DataFrame, coverage: DataFrame) -> DataFrame:
    """(scan_id, missing): adapters without a coverage file, sorted; adapter names are a short fixed list."""
    lacking = adapters.join(coverage.select("scan_id", "adapter"), ["scan_id", "adapter"], "left_anti")
    return lacking.groupBy("scan_id").agg(F.sort_array(F.collect_set("adapter")).alias("missing"))


# Cut-offs of the full scan's checks.
CHECK_CUTOFFS = {"secrets": (0, "FAIL"), "critical": (0, "FAIL"), "misconfigs": (5, "WARN"), "shell_issues": (10, "WARN")}


def check_tally(counts: DataFrame) -> DataFrame:
    """PASS / WARN / FAIL checks per scan; each check passes at or below its cut-off."""
    outcomes = F.array(
        *[
            F.when(F.col(name) > cutoff, F.lit(worse)).otherwise(F.lit("PASS"))
            for name, (cutoff, worse) in CHECK_CUTOFFS.items()
        ]
    )
    rows = counts.withColumn("_o", outcomes)

    def tally(status: str) -> Column:
        return F.size(F.filter("_o", lambda outcome: outcome == status)).cast("bigint").alias(status.lower())

    return rows.select("scan_id", *[tally(status) for status in ("PASS", "WARN", "FAIL")])


def report_sections(facts: DataFrame, coverage_threshold: float = 70.0) -> DataFrame:
    """One row per scan and report section; a null counter means the scan has no such report.

    ``any_error`` of the facts, if there, fails the unit tests also where a counting policy leaves errors out of its sums. Three more
    columns are optional: ``go_failed`` (null without Go tests), which decides over the unit tests as the report read last;
    ``coverage_file`` (a Go or LCOV file is there, but gives no percentage) makes the coverage AVAILABLE; ``local_analysis`` stands in
    for a quality gate that is missing.
    """
    c = F.col
    optional = lambda name, kind: c(name) if name in facts.columns else F.lit(None).cast(kind)
    erred = F.coalesce(optional("any_error", "boolean"), F.lit(False))
    go, file, local = optional("go_failed", "bigint"), optional("coverage_file", "boolean"), optional("local_analysis", "boolean")
    skipped = F.lit("SKIPPED")

    def verdict(present: Column, good: Column) -> Column:
        return F.when(~present, skipped).when(good, F.lit("PASS")).otherwise(F.lit("FAIL"))

    statuses = {
        "unit_tests": F.when(go == 0, F.lit("PASS")).when(go > 0, F.lit("FAIL"))
        .otherwise(verdict(c("test_total").isNotNull(), (c("test_failed") == 0) & (c("test_errors") == 0) & ~erred)),
        "coverage": F.when(file, F.lit("AVAILABLE")).otherwise(verdict(c("coverage_pct").isNotNull(), c("coverage_pct") >= coverage_threshold)),
        "sonarqube": F.coalesce(c("quality_gate"), F.when(local, F.lit("LOCAL_ANALYSIS")), skipped),
        "trivy": verdict(c("critical").isNotNull(), c("critical") == 0),
        "secrets": verdict(c("secrets").isNotNull(), c("secrets") == 0),
        "sbom": F.when(c("sbom_components") > 0, F.lit("GENERATED")).otherwise(skipped),
        "other": F.when(c("lint_issues").isNotNull(), F.lit("SCANNED")).otherwise(skipped),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("section"), v.alias("status")) for k, v in statuses.items()])
    return facts.select("scan_id", F.inline(pairs))


def quality_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """Linter metrics folded to one map per scan; a tool that did not run leaves no key.

    Each table is (scan_id, value), already one row per scan, so the union is small and needs no join.
    """
    parts = [
        table.select("scan_id", F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        for name, table in tables.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    metric = {name: F.max(F.when(F.col("metric") == name, F.col("value"))) for name in tables}
    entries = F.array(*[F.struct(F.lit(name), value) for name, value in metric.items()])
    return rows.groupBy("scan_id").agg(
        F.map_filter(F.map_from_entries(entries), lambda _, v: v.isNotNull()).alias("metrics")
    )


def facet_counts(issues: DataFrame) -> DataFrame:
    """Issues by severity and by type. Pairs are counted first; the two facets then fold the few pairs."""
    pairs = issues.groupBy("severity", "type").agg(F.count("*").alias("n"))
    facets = pairs.groupingSets([["severity"], ["type"]], "severity", "type").agg(
        F.sum("n").alias("n"), F.grouping("severity").alias("_g")
    )
    by_type = F.col("_g") == 1
    return facets.select(
        F.when(by_type, "types").otherwise("severities").alias("facet"),
        F.when(by_type, F.col("type")).otherwise(F.col("severity")).alias("value"),
        "n",
    )
