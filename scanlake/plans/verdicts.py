"""Queries over gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.operators import gates, totals
from scanlake.operators.rules import license_text
from scanlake.plans import bindings as b
from scanlake.plans import counting, ingest
from scanlake.plans.registry import query
from scanlake.sources import quality


def checks(spark, sf):
    return counting.check_counts(spark, sf)


@query(
    "gate_critical_or_secret",
    "G1",
    f"with {counting.CHECKS_SQL} select scan_id, case when critical > 0 or secrets > 0 then 'FAIL' else 'PASS' end as gate from checks",
)
def critical_or_secret(spark, sf):
    return checks(spark, sf).select("scan_id", gates.critical_or_secret().alias("gate"))


@query(
    "gate_critical",
    "G2",
    f"with {counting.CHECKS_SQL} select scan_id, case when critical > 0 then 'FAIL' else 'PASS' end as gate from checks",
)
def critical(spark, sf):
    return checks(spark, sf).select("scan_id", gates.critical_only().alias("gate"))


@query(
    "gate_tri_state",
    "G3",
    f"""with {counting.CHECKS_SQL}
    select scan_id, case when critical > 0 then 'FAIL' when high > 0 then 'WARN' else 'PASS' end as image_status,
      case when critical > 0 then 'FAIL' when high > 0 then 'WARNING' else 'PASS' end as run_status from checks""",
)
def tri_state(spark, sf):
    return checks(spark, sf).select(
        "scan_id", gates.tri_state().alias("image_status"), gates.tri_state(warn="WARNING").alias("run_status")
    )


@query(
    "gate_comprehensive",
    "G4",
    f"""with {counting.FACTS_SQL}
    select scan_id, case when coalesce(critical, 0) > 0 or coalesce(lint_issues, 0) > 3 then 'FAIL'
      when coalesce(high, 0) > 10 or coalesce(test_failed, 0) > 0 then 'WARNING' else 'PASS' end as gate from facts""",
)
def comprehensive(spark, sf):
    """Blockers are the lint entries above three; secrets stay out, so all outcomes occur."""
    facts = counting.section_facts(spark, sf).withColumn("blockers", F.greatest(F.col("lint_issues") - 3, F.lit(0)))
    return facts.select("scan_id", gates.comprehensive(secrets=F.lit(0)).alias("gate"))


for _console in (False, True):
    _name = "gate_full_scan_console" if _console else "gate_full_scan"
    _broken = "critical > 0" if _console else "critical > 0 or secrets > 0"

    @query(
        _name,
        "G5",
        f"""with {counting.CHECKS_SQL}
        select scan_id, case when {_broken} then 'FAIL' when 6 * high > 10 then 'WARNING' else 'PASS' end as gate from checks""",
    )
    def full_scan(spark, sf, console=_console):
        """HIGH counts are scaled so that more than ten occur."""
        return checks(spark, sf).select("scan_id", gates.full_scan(high=F.col("high") * 6, console=console).alias("gate"))


@query(
    "gate_unified",
    "G6",
    f"""with {counting.FACTS_SQL}, f as (
      select scan_id, coalesce(critical, 0) as critical, coalesce(test_failed, 0) + coalesce(test_errors, 0) as failed, coverage_pct,
        (scan_id like '%1' or scan_id like '%5' or scan_id like '%9') as strict, case when lint_issues > 1 then 1 else 0 end as warnings from facts), r as (
      select *, concat_ws('; ', case when critical > 0 then 'critical findings: ' || critical end,
        case when failed > 0 then 'failed tests/errors: ' || cast(failed as bigint) end,
        case when coverage_pct < 50.5 then 'coverage below threshold: ' || format('{{:.1f}}', coverage_pct) || '% < 50.5%' end) as reasons from f)
    select scan_id, reasons, case when reasons <> '' and strict then 'FAIL' when reasons <> '' or warnings > 0 then 'DEGRADED' else 'PASS' end as gate from r""",
)
def unified(spark, sf):
    facts = counting.section_facts(spark, sf)
    failed = F.coalesce("test_failed", F.lit(0)) + F.coalesce("test_errors", F.lit(0))
    strict = F.col("scan_id").rlike("[159]$")
    rows = facts.withColumn("reasons", gates.unified_reasons(failed=failed, threshold=50.5))
    warnings = F.when(F.col("lint_issues") > 1, 1).otherwise(0)
    return rows.select(
        "scan_id", F.array_join("reasons", "; ").alias("reasons"),
        gates.unified_status(F.col("reasons"), warnings, strict).alias("gate"),
    )


def gate_texts(spark, sf):
    """Gate files of four kinds by the scan's last digit: with a status, without one, in words, or absent."""
    counts = checks(spark, sf)
    last = F.substring("scan_id", -1, 1)
    head = F.concat(F.lit("CRITICAL_VULNS="), F.col("critical").cast("string"))
    verdict = F.when(F.col("critical") > 0, "fail").otherwise("Pass")
    text = (
        F.when(last.isin("0", "1", "2"), F.concat(head, F.lit("\nGATE_STATUS = "), verdict))
        .when(last.isin("3", "4", "5"), head)
        .when(last.isin("6", "7"), F.concat(head, F.lit("\nresult: "), F.when(F.col("secrets") > 3, "FAILED").otherwise("fine")))
    )
    return counts.withColumn("gate_text", text)


@query(
    "gate_from_file",
    "G7",
    f"""with {counting.CHECKS_SQL}
    select scan_id, case when right(scan_id, 1) in ('0','1','2') then case when critical > 0 then 'false' else 'true' end
      when right(scan_id, 1) in ('3','4','5') then 'true'
      when right(scan_id, 1) in ('6','7') then case when secrets > 3 then 'false' else 'true' end
      else case when critical > 0 then 'false' else 'true' end end as gate_passed from checks""",
)
def from_file(spark, sf):
    return gate_texts(spark, sf).select("scan_id", gates.from_gate_file().cast("string").alias("gate_passed"))


@query(
    "gate_coverage",
    "G8",
    f"""with {counting.ADAPTER_COVERAGE_SQL}
    select scan_id, adapter, case when line_pct is null then 'SKIP' when line_pct < 50 then 'FAIL' else 'PASS' end as gate from cov""",
)
def coverage(spark, sf):
    return counting.adapter_coverage(spark, sf).select("scan_id", "adapter", gates.coverage("line_pct", 50.0).alias("gate"))


@query(
    "gate_policy",
    "G9",
    f"""with {counting.FACTS_SQL}, m as (select scan_id, critical, 4 * high as high, 20 * secrets as medium, coverage_pct from facts)
    select scan_id, 'critical' as metric, critical::double as value, 0.0::double as threshold,
      case when critical is null then 'SKIP' when critical > 0 then 'FAIL' else 'PASS' end as outcome from m
    union all select scan_id, 'high', high::double, 10.0::double, case when high is null then 'SKIP' when high > 10 then 'WARN' else 'PASS' end from m
    union all select scan_id, 'medium', medium::double, 50.0::double, case when medium is null then 'SKIP' when medium > 50 then 'INFO' else 'PASS' end from m
    union all select scan_id, 'coverage_pct', coverage_pct, 70.0::double, case when coverage_pct is null then 'SKIP' when coverage_pct < 70 then 'FAIL' else 'PASS' end from m""",
)
def policy(spark, sf):
    facts = counting.section_facts(spark, sf).select(
        "scan_id", "critical", (F.col("high") * 4).alias("high"), (F.col("secrets") * 20).alias("medium"), "coverage_pct"
    )
    return gates.policy(facts)


@query(
    "gate_cvss",
    "G10",
    f"""with {b.EVENTS_SQL}
    select 'scan-' || k as scan_id, max(value % 10) as worst_cvss, case when max(value % 10) >= 9.95 then 'FAIL' else 'PASS' end as gate
    from builds group by k""",
)
def cvss(spark, sf):
    rows = b.events(spark, sf).select(F.concat(F.lit("scan-"), "k").alias("scan_id"), (F.col("value") % 10).alias("cvss"))
    return gates.cvss(rows, minimum=9.95)


@query(
    "rollup_result",
    "G11",
    f"""with {b.EVENTS_SQL}
    select user_id, job, day(ts)::bigint as day, case when bool_or(result = 'FAILURE') then 'FAILURE' when bool_or(result = 'UNSTABLE') then 'UNSTABLE' else 'SUCCESS' end as overall_result
    from builds group by user_id, job, day(ts)""",
)
def rollup(spark, sf):
    rows = b.events(spark, sf).withColumn("day", F.dayofmonth("ts").cast("bigint"))
    return gates.rollup_result(rows, ("user_id", "job", "day"))


@query(
    "quality_gate_status",
    "G12",
    f"""with {ingest.GATE_FILES_SQL}
    select scan_id, file, case status when 'OK' then 'PASSED' when 'ERROR' then 'FAILED' else coalesce(status, 'UNKNOWN') end as label from gate_status""",
)
def quality_status(spark, sf):
    rows = quality.read_quality_gate(ingest.gate_files(spark, sf))
    return rows.select("scan_id", "file", gates.quality_gate_label().alias("label"))


@query(
    "quality_gate_blockers",
    "G12",
    f"""with {ingest.GATE_FILES_SQL}
    select scan_id, file, 'BLOCKER' as severity, 'Quality Gate FAILED: toxic' as title,
      'Actual: ' || toxic || ' (threshold: 0)' as detail from gate_status where toxic > 0 and n % 2 = 1""",
)
def quality_blockers(spark, sf):
    conditions = quality.gate_conditions(quality.read_quality_gate(ingest.gate_files(spark, sf)))
    return gates.condition_blockers(conditions).select("scan_id", "file", "severity", "title", "detail")


@query(
    "gate_license",
    "G13 T4",
    r"""with l as (select doc_id, regexp_extract(text, '(AGPL-[0-9.]+|MIT|Apache|GNU General Public)( License|\b)', 1) as license from documents)
    select doc_id, license from l where license in ('GNU General Public', 'AGPL-3.0')""",
)
def licenses(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", license_text("text").alias("license"))
    return gates.license_violations(docs, ("GNU General Public", "AGPL-3.0"))


@query(
    "phase_status",
    "G14",
    f"""with {b.EVENTS_SQL}
    select number, case when result = 'FAILURE' and job = 'job-0' then 'FAIL' when result = 'FAILURE' then 'DEGRADED' else 'PASS' end as status from builds""",
)
def phase(spark, sf):
    failed = F.coalesce(F.col("result") == "FAILURE", F.lit(False))
    return b.events(spark, sf).select("number", gates.phase_status(failed, F.col("job") == "job-0").alias("status"))


@query(
    "tool_verdict",
    "G14",
    f"""with {b.EVENTS_SQL}, tools as (
      select user_id, case when event_type in ('signup','error') then 'trivy' when event_type = 'view' then 'sonar-scanner' else 'pytest' end as tool,
        value > 2 as available, event_type in ('signup','error') as required from builds)
    select user_id as scan_id, coalesce(string_agg(distinct tool, ', ' order by tool) filter (not available and required), '') as missing_required,
      coalesce(string_agg(distinct tool, ', ' order by tool) filter (not available and not required), '') as missing_optional from tools group by user_id""",
)
def tools(spark, sf):
    kind = F.col("event_type")
    required = kind.isin("signup", "error")
    rows = b.events(spark, sf).select(
        F.col("user_id").alias("scan_id"),
        F.when(required, "trivy").when(kind == "view", "sonar-scanner").otherwise("pytest").alias("tool"),
        (F.col("value") > 2).alias("available"), required.alias("required"),
    )
    return gates.tool_verdict(rows)


@query(
    "scan_gate_policies",
    "A1 G2",
    f"""with {b.FINDINGS_SQL} select scan_id, case when count(*) filter (kind = 'vuln' and severity_raw = 'CRITICAL') > 0 then 'FAIL' else 'PASS' end as gate
    from findings group by scan_id""",
)
def strict_gate(spark, sf):
    counts = totals.severity_totals(b.findings(spark, sf), policy="critical_only")
    return counts.select("scan_id", gates.critical_only().alias("gate"))
