"""Gates: verdict columns over counters. They never need a shuffle of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.numbers import one_digit_text
from scanlake.sources.textual import key_value_entries, last_value

# Default thresholds of the policy file.
POLICY_THRESHOLDS = (
    ("critical", "above", 0.0, "FAIL"),
    ("high", "above", 10.0, "WARN"),
    ("medium", "above", 50.0, "INFO"),
    ("coverage_pct", "below", 70.0, "FAIL"),
)
# Licences that fail a component.
FORBIDDEN_LICENSES = ("AGPL-1.0", "AGPL-3.0")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _n(col: str | Column) -> Column:
    return F.coalesce(_c(col), F.lit(0))


def critical_or_secret(critical="critical", secrets="secrets") -> Column:
    return F.when((_n(critical) > 0) | (_n(secrets) > 0), "FAIL").otherwise("PASS")


def critical_only(critical="critical") -> Column:
    return F.when(_n(critical) > 0, "FAIL").otherwise("PASS")


def tri_state(critical="critical", high="high", warn: str = "WARN") -> Column:
    """``warn`` is WARN for one image and WARNING for a whole run."""
    return F.when(_n(critical) > 0, "FAIL").when(_n(high) > 0, warn).otherwise("PASS")


def comprehensive(critical="critical", high="high", secrets="secrets", blockers="blockers", failed="test_failed") -> Column:
    broken = (_n(critical) > 0) | (_n(secrets) > 0) | (_n(blockers) > 0)
    return F.when(broken, "FAIL").when((_n(high) > 10) | (_n(failed) > 0), "WARNING").otherwise("PASS")


def full_scan(critical="critical", high="high", secrets="secrets", console: bool = False) -> Column:
    """The console verdict does not look at secrets."""
    broken = _n(critical) > 0
    if not console:
        broken = broken | (_n(secrets) > 0)
    return F.when(broken, "FAIL").when(_n(high) > 10, "WARNING").otherwise("PASS")


def unified_reasons(critical="critical", failed="test_failed", coverage="coverage_pct", threshold: float = 70.0) -> Column:
    """Reasons in fixed order; a null coverage never gives one."""
    pct = one_digit_text(_c(coverage))
    cutoff = f"{float(threshold)}"
    return F.array_compact(
        F.array(
            F.when(_n(critical) > 0, F.concat(F.lit("critical findings: "), _n(critical).cast("string"))),
            F.when(_n(failed) > 0, F.concat(F.lit("failed tests/errors: "), _n(failed).cast("string"))),
            F.when(
                _c(coverage) < threshold,
                F.concat(F.lit("coverage below threshold: "), pct, F.lit(f"% < {cutoff}%")),
            ),
        )
    )


def unified_status(reasons: Column, warnings: Column, strict: Column) -> Column:
    """Any reason: FAIL when strict, else DEGRADED. Warnings alone: DEGRADED."""
    return (
        F.when((F.size(reasons) > 0) & strict, "FAIL")
        .when((F.size(reasons) > 0) | (_n(warnings) > 0), "DEGRADED")
        .otherwise("PASS")
    )


def from_gate_file(text="gate_text", critical="critical") -> Column:
    """True when the scan passes by its gate file.

    GATE_STATUS decides; without a usable one the word "fail" anywhere does. Without a file criticals fail.
    """
    body = _c(text)
    status = F.upper(last_value(key_value_entries(body), "GATE_STATUS"))
    by_file = (
        F.when(status == "FAIL", False).when(status == "PASS", True).otherwise(~F.lower(body).contains("fail"))
    )
    return F.when(body.isNull(), _n(critical) == 0).otherwise(by_file)


def coverage(pct="coverage_pct", threshold: float = 70.0) -> Column:
    return F.when(_c(pct).isNull(), "SKIP").when(_c(pct) < threshold, "FAIL").otherwise("PASS")


def policy(counts: DataFrame, thresholds=POLICY_THRESHOLDS) -> DataFrame:
    """One row per scan and threshold, from a threshold table of a few literal rows; null values are not judged."""
    checks = []
    for metric, side, limit, outcome in thresholds:
        value = F.col(metric).cast("double")
        broken = value > limit if side == "above" else value < limit
        checks.append(
            F.struct(
                F.lit(metric).alias("metric"),
                value.alias("value"),
                F.lit(limit).alias("threshold"),
                F.when(value.isNull(), "SKIP").when(broken, outcome).otherwise("PASS").alias("outcome"),
            )
        )
    return counts.select("scan_id", F.inline(F.array(*checks)))


def cvss(findings: DataFrame, minimum: float = 7.0) -> DataFrame:
    worst = F.max("cvss")
    return findings.groupBy("scan_id").agg(
        worst.alias("worst_cvss"), F.when(worst >= minimum, "FAIL").otherwise("PASS").alias("gate")
    )


def rollup_result(builds: DataFrame, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """FAILURE beats UNSTABLE beats SUCCESS; no other result lowers the outcome."""
    rank = F.when(F.col("result") == "FAILURE", 2).when(F.col("result") == "UNSTABLE", 1).otherwise(0)
    worst = F.max(rank)
    label = F.when(worst == 2, "FAILURE").when(worst == 1, "UNSTABLE").otherwise("SUCCESS")
    return builds.groupBy(*by).agg(label.alias("overall_result"))


def quality_gate_label(status="status") -> Column:
    return F.when(_c(status) == "OK", "PASSED").when(_c(status) == "ERROR", "FAILED").otherwise(
        F.coalesce(_c(status), F.lit("UNKNOWN"))
    )


def condition_blockers(conditions: DataFrame) -> DataFrame:
    """Each condition in ERROR is a BLOCKER issue."""
    return conditions.where("status = 'ERROR'").select(
        "scan_id",
        "file",
        "pos",
        F.lit("SonarQube").alias("source"),
        F.lit("BLOCKER").alias("severity"),
        F.concat(F.lit("Quality Gate FAILED: "), "metric").alias("title"),
        F.concat(F.lit("Actual: "), "actual", F.lit(" (threshold: "), "threshold", F.lit(")")).alias("detail"),
    )


def license_violations(components: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_LICENSES) -> DataFrame:
    """Components under a forbidden licence; the list is short and literal, so the test is part of the scan."""
    return components.where(F.col("license").isin(*forbidden))


def phase_status(failed: Column, strict: Column) -> Column:
    """A phase that raised is FAIL when strict, else DEGRADED."""
    return F.when(failed & strict, "FAIL").when(failed, "DEGRADED").otherwise("PASS")


def tool_verdict(tools: DataFrame) -> DataFrame:
    """Per scan: missing required tools stop the phase, missing optional ones are a warning.

    ``tools`` is (scan_id, tool, available, required); tool names are a short fixed list.
    """
    missing = ~F.col("available")
    names = {
        "missing_required": F.collect_set(F.when(missing & F.col("required"), F.col("tool"))),
        "missing_optional": F.collect_set(F.when(missing & ~F.col("required"), F.col("tool"))),
    }
    return tools.groupBy("scan_id").agg(
        *[F.array_join(F.sort_array(expr), ", ").alias(name) for name, expr in names.items()]
    )


