"""Queries over severity scalars, counters, tests and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions.severity import normalize_severity, severity_filter, severity_rank
from scanlake.operators import gates, joins, totals
from scanlake.operators.ranking import first_per_key
from scanlake.plans import bindings as b
from scanlake.plans import ingest
from scanlake.plans.registry import query
from scanlake.session import staged
from scanlake.sources import components, lint, quality, scanners, tests_coverage as tc

COUNTS = ("critical", "high", "medium", "low", "unknown")


def sql_counts(where: str = "true", level: str = "severity") -> str:
    return ",\n      ".join(
        f"count(*) filter ({where} and {level} = '{name.upper()}') as {name}" for name in COUNTS
    )


@query(
    "normalize_severity",
    "P1",
    f"with {b.FINDINGS_SQL} select ord, kind, severity, severity_high from leveled",
)
def normalize(spark, sf):
    return b.findings(spark, sf).select(
        "ord", "kind", normalize_severity("severity_raw").alias("severity"),
        normalize_severity("severity_raw", default="HIGH").alias("severity_high"),
    )


@query(
    "severity_rank",
    "P2",
    f"""with {b.FINDINGS_SQL}
    select coalesce(severity_raw, 'none') as severity, case upper(severity_raw) when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2
      when 'LOW' then 3 when 'UNKNOWN' then 4 else 5 end::bigint as rank, count(*) as n from findings group by all""",
)
def rank(spark, sf):
    f = b.findings(spark, sf)
    return f.groupBy(
        F.coalesce("severity_raw", F.lit("none")).alias("severity"),
        severity_rank("severity_raw").cast("bigint").alias("rank"),
    ).agg(F.count("*").alias("n"))


@query(
    "severity_filter",
    "P3",
    "select o_custkey as scan, o_orderkey as ord from orders where o_orderpriority in ('1-URGENT', '3-MEDIUM')",
)
def filter_severity(spark, sf):
    """The list becomes an IN on the stored column, so the Parquet scan prunes by it."""
    orders = b.table(spark, sf, "orders")
    return orders.where(severity_filter("o_orderpriority", "1-URGENT, 3-medium")).select(
        F.col("o_custkey").alias("scan"), F.col("o_orderkey").alias("ord")
    )


def scans_with_modes(spark, sf):
    """Market segment gives the mode, a positive balance an image."""
    segment = F.col("c_mktsegment")
    mode = (
        F.when(segment == "BUILDING", "code-only").when(segment == "HOUSEHOLD", "image-only")
        .when(segment == "MACHINERY", "full").otherwise("k8s-manifests")
    )
    return b.table(spark, sf, "customer").select(
        F.concat(F.lit("scan-"), F.col("c_custkey").cast("string")).alias("scan_id"),
        mode.alias("mode"),
        (F.col("c_acctbal") > 0).alias("has_image"),
    )


MODES_SQL = """modes as (
  select 'scan-' || c_custkey as scan_id, case c_mktsegment when 'BUILDING' then 'code-only' when 'HOUSEHOLD' then 'image-only'
    when 'MACHINERY' then 'full' else 'k8s-manifests' end as mode, c_acctbal > 0 as has_image from customer)
"""


@query(
    "scan_modes",
    "P18",
    f"""with {MODES_SQL}, kinds(mode, report_kind) as (values ('code-only','trivy-fs'), ('code-only','trivy-config'), ('code-only','sbom'),
      ('image-only','trivy-image'), ('full','trivy-fs'), ('full','trivy-config'), ('full','trivy-image'), ('full','sbom'),
      ('k8s-manifests','trivy-fs'), ('k8s-manifests','trivy-config'), ('k8s-manifests','sbom'))
    select scan_id, mode, report_kind from modes join kinds using (mode) where report_kind <> 'trivy-image' or has_image""",
)
def modes(spark, sf):
    return joins.scan_modes(scans_with_modes(spark, sf))


POLICY_SQL = {
    "api": sql_counts("kind <> 'secret'"),
    "unified": sql_counts("true", "case when kind = 'secret' then severity_high else severity end"),
    "summary": sql_counts("kind <> 'secret'"),
    "gate": sql_counts("kind = 'vuln'").replace(
        "count(*) filter (kind = 'vuln' and severity = 'UNKNOWN')", "cast(0 as bigint)"
    ),
    "gate_strict": """count(*) filter (kind = 'vuln' and severity_raw = 'CRITICAL') as critical,
      count(*) filter (kind = 'vuln' and severity_raw = 'HIGH') as high, 0::bigint as medium, 0::bigint as low, 0::bigint as unknown""",
    "critical_only": """count(*) filter (kind = 'vuln' and severity_raw = 'CRITICAL') as critical,
      0::bigint as high, 0::bigint as medium, 0::bigint as low, 0::bigint as unknown""",
    "comprehensive": """count(*) filter (kind = 'vuln' and severity_raw = 'CRITICAL') as critical,
      count(*) filter (kind = 'vuln' and severity_raw = 'HIGH') as high, 0::bigint as medium, 0::bigint as low, 0::bigint as unknown""",
}

for _policy, _sql in POLICY_SQL.items():
    _own = "severity" if totals.POLICIES[_policy].fold else "severity_raw"

    @query(
        f"severity_totals_{_policy}",
        "A1",
        f"""with {b.FINDINGS_SQL} select scan_id, {_sql}, count(*) filter (kind = 'secret') as secrets,
        count(*) filter (kind = 'misconfig' and {_own} = 'CRITICAL') as misconfig_critical,
        count(*) filter (kind = 'misconfig' and {_own} = 'HIGH') as misconfig_high
        from leveled group by scan_id""",
    )
    def by_policy(spark, sf, policy=_policy):
        return totals.severity_totals(b.findings(spark, sf), policy=policy)


def lint_low(spark, sf):
    """Linter entries per scan from JSON lists: one tool for the LOW orders, the other for all other priorities."""
    item = F.struct(F.lit("info").alias("level"))
    tool = F.when(F.col("severity_raw") == "LOW", "shellcheck").otherwise("hadolint")
    return lint.lint_as_low(b.lint_files(spark, sf, item, extra={"tool": tool}))


LOW_SQL = """low_entries as (
  select scan_id, case severity_raw when 'LOW' then 'shellcheck' else 'hadolint' end as report, count(*) as low
  from findings group by all)
"""


@query("lint_as_low", "A23", f"with {b.FINDINGS_SQL}, {LOW_SQL} select scan_id, report as tool, low from low_entries")
def lint_as_low(spark, sf):
    return lint_low(spark, sf)


@query(
    "totals_by_type",
    "A2 A23",
    f"""with {b.FINDINGS_SQL}, {LOW_SQL}, c as (
      select scan_id, report, {sql_counts()} from leveled where kind <> 'secret' group by scan_id, report
      union all select scan_id, report, 0, 0, 0, low, 0 from low_entries)
    select scan_id, case when grouping(report) = 1 then 'TOTAL' else report end as report,
      {", ".join(f"cast(sum({n}) as bigint) as {n}" for n in COUNTS)}
    from c group by grouping sets ((scan_id, report), (scan_id))""",
)
def by_type(spark, sf):
    return totals.totals_by_type(b.findings(spark, sf), lint_low(spark, sf))


@query(
    "totals_by_tool",
    "A3",
    f"""with {b.FINDINGS_SQL}, l as (select *, case when kind = 'secret' then severity_high else severity end as sev from leveled)
    select scan_id, case when grouping(tool) = 1 then 'TOTAL' else tool end as tool, {sql_counts("true", "sev")}
    from l group by grouping sets ((scan_id, tool), (scan_id))""",
)
def by_tool(spark, sf):
    return totals.totals_by_tool(b.findings(spark, sf))


@query(
    "count_secrets",
    "A4",
    f"with {b.FINDINGS_SQL} select scan_id, count(*) filter (kind = 'secret') as secrets from findings group by scan_id",
)
def secrets(spark, sf):
    return totals.count_secrets(scanners.read_vuln_reports(b.vuln_reports(spark, sf), "Results array<struct<Secrets:array<struct<RuleID:string>>>>"))


@query(
    "misconfig_high_count",
    "A5",
    f"""with {b.FINDINGS_SQL} select scan_id, count(*) filter (kind = 'misconfig' and severity in ('CRITICAL','HIGH')) as misconfigs
    from leveled group by scan_id""",
)
def misconfigs(spark, sf):
    return totals.misconfig_high_count(b.findings(spark, sf))


@query(
    "sbom_component_count",
    "A6",
    f"""with {b.COMPONENTS_SQL}
    select scan_id, 'sbom-' || part || '.json' as file, case when scan_id like '%3' then null else count(*) end as components
    from components group by scan_id, part""",
)
def sbom_count(spark, sf):
    """Inventories of scans that end in 3 are cut off: their count is null, not 0."""
    files = b.sbom_files(spark, sf)
    broken = F.when(F.col("scan_id").endswith("3"), F.lit("{")).otherwise(F.col("content"))
    return components.sbom_component_count(files.withColumn("content", broken))


@query(
    "sbom_type_histogram",
    "A7",
    f"with {b.COMPONENTS_SQL} select scan_id, type, count(*) as n from components group by scan_id, type",
)
def sbom_types(spark, sf):
    return totals.sbom_type_histogram(components.read_sbom(b.sbom_files(spark, sf)))


@query(
    "sbom_totals",
    "A8",
    f"""with {b.COMPONENTS_SQL} select scan_id, count(*) as components, count(distinct part) as sbom_files
    from components group by scan_id""",
)
def sbom_totals(spark, sf):
    return totals.sbom_totals(components.sbom_component_count(b.sbom_files(spark, sf)))


def suites(spark, sf):
    """Two frameworks: one suite file per supplier and return flag; covered lines are read as failures, R as errors."""
    c = b.coverage_counts(spark, sf)
    failures = F.col("covered")
    errors = F.when(F.col("adapter") == "R", F.col("total")).otherwise(0)
    xml = F.concat(
        F.lit('<testsuite tests="'), F.col("total").cast("string"), F.lit('" failures="'), failures.cast("string"),
        F.lit('" errors="'), errors.cast("string"), F.lit('" skipped="3"/>'),
    )
    framework = F.when(F.col("file").startswith("N"), "pytest").otherwise("JUnit")
    return tc.read_junit(c.select("scan_id", "file", xml.alias("content"))).withColumn("framework", framework)


SUITES_SQL = f"""{b.COVERAGE_SQL}, suites as (
  select scan_id, case adapter when 'N' then 'pytest' else 'JUnit' end as framework, total as tests, covered as failures,
    case adapter when 'R' then total else 0 end as errors, 3 as skipped from counts)
"""


@query(
    "test_totals",
    "A9",
    f"""with {SUITES_SQL}
    select scan_id, case when grouping(framework) = 1 then 'ALL' else framework end as framework,
      cast(sum(tests) as bigint) as total, cast(sum(failures) as bigint) as failed, cast(sum(errors) as bigint) as errors,
      cast(sum(greatest(tests - failures - errors - skipped, 0)) as bigint) as passed
    from suites group by grouping sets ((scan_id, framework), (scan_id))""",
)
def tests(spark, sf):
    return totals.test_totals(suites(spark, sf))


for _variant, _passed, _errors in (
    ("pytest", "tests - errors - failures - skipped", "errors"), ("junit", "tests - errors - failures", "0")
):

    @query(
        f"test_totals_report_{_variant}",
        "A10",
        f"""with {SUITES_SQL}
        select scan_id, cast(sum(tests) as bigint) as test_total, cast(sum({_passed}) as bigint) as test_passed,
          cast(sum(failures) as bigint) as test_failed, cast(sum({_errors}) as bigint) as test_errors from suites group by scan_id""",
    )
    def report_tests(spark, sf, variant=_variant):
        return totals.test_totals_report(suites(spark, sf), variant).drop("any_error")


def adapter_coverage(spark, sf):
    """Line rates per scan and adapter; reports of scans that end in 5 lack the R adapter, those in 9 have no value."""
    rows = tc.read_lcov(ingest.lcov_files(spark, sf)).withColumn("adapter", F.substring("file", 1, 1))
    rows = rows.where(~(F.col("scan_id").endswith("5") & (F.col("adapter") == "R")))
    return rows.withColumn("line_pct", F.when(~F.col("scan_id").endswith("9"), F.col("line_pct")))


ADAPTER_COVERAGE_SQL = f"""{b.COVERAGE_SQL}, cov as (
  select scan_id, adapter, case when scan_id like '%9' then null else {b.sql_pct('2 * covered', '2 * total')} end as line_pct
  from counts where not (scan_id like '%5' and adapter = 'R'))
"""
OVERALL_SQL = "cast(format('{:.1f}', avg(line_pct)) as double)"


@query(
    "coverage_overall",
    "A11",
    f"with {ADAPTER_COVERAGE_SQL} select scan_id, {OVERALL_SQL} as coverage_pct from cov group by scan_id",
)
def overall(spark, sf):
    return totals.coverage_overall(adapter_coverage(spark, sf))


@query(
    "coverage_missing",
    "A12",
    f"""with {ADAPTER_COVERAGE_SQL}, need as (select distinct scan_id, unnest(['A','N','R','X']) as adapter from counts)
    select scan_id, string_agg(adapter, ',' order by adapter) as missing
    from need anti join cov using (scan_id, adapter) group by scan_id""",
)
def missing(spark, sf):
    have = adapter_coverage(spark, sf)
    scans = b.coverage_counts(spark, sf).select("scan_id").distinct()
    need = scans.select("scan_id", F.explode(F.array(*[F.lit(a) for a in "ANRX"])).alias("adapter"))
    rows = totals.coverage_missing(need, have)
    return rows.select("scan_id", F.array_join("missing", ",").alias("missing"))


@query(
    "image_scan_summary",
    "A13 G3",
    f"""with {b.FINDINGS_SQL}, i as (
      select 'registry.local:5000/' || package || ':' || target as image, count(*) filter (kind = 'vuln' and severity_raw = 'CRITICAL') as critical,
        count(*) filter (kind = 'vuln' and severity_raw = 'HIGH') as high from findings group by 1)
    select image, 1::bigint as images, critical, high, case when critical > 0 then 'FAIL' when high > 0 then 'WARN' else 'PASS' end as status from i
    union all select 'TOTAL', count(*), cast(sum(critical) as bigint), cast(sum(high) as bigint),
      case when sum(critical) > 0 then 'FAIL' when sum(high) > 0 then 'WARNING' else 'PASS' end from i""",
)
def images(spark, sf):
    image = F.concat(F.lit("registry.local:5000/"), "package", F.lit(":"), "target")
    rows = b.findings(spark, sf).withColumn("image", image)
    return totals.image_scan_summary(rows, gates.tri_state(), gates.tri_state(warn="WARNING"))


def check_counts(spark, sf):
    """Per scan: secrets, criticals, bad misconfigurations; lint entries stand for shell issues."""
    counts = totals.severity_totals(b.findings(spark, sf), policy="gate")
    return counts.select(
        "scan_id", "secrets", "critical", "high",
        (F.col("misconfig_critical") + F.col("misconfig_high")).alias("misconfigs"),
        (F.col("medium") * 5).alias("shell_issues"),
    )


CHECKS_SQL = f"""{b.FINDINGS_SQL}, checks as (
  select scan_id, count(*) filter (kind = 'secret') as secrets, count(*) filter (kind = 'vuln' and severity = 'CRITICAL') as critical,
    count(*) filter (kind = 'vuln' and severity = 'HIGH') as high,
    count(*) filter (kind = 'misconfig' and severity in ('CRITICAL','HIGH')) as misconfigs,
    5 * count(*) filter (kind = 'vuln' and severity = 'MEDIUM') as shell_issues from leveled group by scan_id)
"""


@query(
    "check_tally",
    "A16",
    f"""with {CHECKS_SQL}
    select scan_id, (secrets = 0)::bigint + (critical = 0)::bigint + (misconfigs <= 5)::bigint + (shell_issues <= 10)::bigint as pass,
      (misconfigs > 5)::bigint + (shell_issues > 10)::bigint as warn, (secrets > 0)::bigint + (critical > 0)::bigint as fail from checks""",
)
def tally(spark, sf):
    return totals.check_tally(check_counts(spark, sf))


def section_facts(spark, sf):
    """Scans are customers; tests and coverage exist for those that are suppliers too, the rest have no such report."""
    scans = b.table(spark, sf, "customer").select(F.concat(F.lit("scan-"), F.col("c_custkey").cast("string")).alias("scan_id"))
    parts = {
        "totals": totals.severity_totals(b.findings(spark, sf), policy="gate").select("scan_id", "critical", "high", "secrets"),
        "tests": totals.test_totals_report(suites(spark, sf)),
        "coverage": totals.coverage_overall(adapter_coverage(spark, sf)),
        "lint": lint_low(spark, sf).groupBy("scan_id").agg(F.sum("low").alias("lint_issues")),
    }
    return joins.scan_summary(scans, parts)


def report_facts(spark, sf):
    """``section_facts`` and what the other reports of a scan say: Go tests, coverage files, quality gate or local analysis, inventory."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    scan = F.concat(F.lit("scan-"), k.cast("string")).alias("scan_id")
    customers = b.table(spark, sf, "customer")
    status = F.when(n % 3 == 0, "error").when(n % 3 == 1, "OK").otherwise("")
    gates_ = customers.where("c_custkey % 2 = 0").select(scan, F.lit("quality-gate-status.json").alias("file"), F.to_json(F.struct(F.struct(status.alias("status")).alias("projectStatus"))).alias("content"))
    kinds = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda x: F.struct(x.cast("string").alias("type")))
    boms = customers.where("c_custkey % 7 < 5").select(scan, F.lit("sbom.json").alias("file"), F.to_json(F.struct(kinds.alias("components"))).alias("content"))
    parts = {
        "go": ingest.read_go_tests(spark, sf).select("scan_id", F.col("failed").alias("go_failed")),
        "files": customers.select(scan, (k % 11 == 0).alias("coverage_file"), (k % 3 == 0).alias("local_analysis")),
        "gate": quality.read_quality_gate(gates_).select("scan_id", F.col("status").alias("quality_gate")),
        "sbom": components.sbom_component_count(boms).select("scan_id", F.col("components").alias("sbom_components")),
    }
    return joins.scan_summary(section_facts(spark, sf), parts)


FACTS_SQL = f"""{b.FINDINGS_SQL}, {ADAPTER_COVERAGE_SQL}, {LOW_SQL},
suites as (select scan_id, total as tests, covered as failures, case adapter when 'R' then total else 0 end as errors from counts),
t as (select scan_id, sum(failures) as test_failed, sum(errors) as test_errors from suites group by scan_id),
cv as (select scan_id, {OVERALL_SQL} as coverage_pct from cov group by scan_id),
li as (select scan_id, sum(low) as lint_issues from low_entries group by scan_id),
tt as (select scan_id, count(*) filter (kind = 'vuln' and severity = 'CRITICAL') as critical,
  count(*) filter (kind = 'vuln' and severity = 'HIGH') as high, count(*) filter (kind = 'secret') as secrets from leveled group by scan_id),
facts as (
  select 'scan-' || c_custkey as scan_id, critical, high, secrets, test_failed, test_errors, coverage_pct, lint_issues
  from customer left join tt on tt.scan_id = 'scan-' || c_custkey left join t on t.scan_id = 'scan-' || c_custkey
  left join cv on cv.scan_id = 'scan-' || c_custkey left join li on li.scan_id = 'scan-' || c_custkey)
"""


REPORT_SECTIONS_SQL = f"""{FACTS_SQL},
go as (select 'scan-' || json_extract_string(props, '$.k') as scan_id, count(*) filter (event_type = 'error') as go_failed from events group by 1),
told as (
  select f.*, go_failed, c_custkey as k, c_nationkey as n from facts f join customer on f.scan_id = 'scan-' || c_custkey left join go on go.scan_id = f.scan_id),
report_sections as (
  select scan_id, 'unit_tests' as section, case when go_failed = 0 then 'PASS' when go_failed > 0 then 'FAIL' when test_failed is null then 'SKIPPED' when test_failed = 0 and test_errors = 0 then 'PASS' else 'FAIL' end as status from told
  union all select scan_id, 'coverage', case when k % 11 = 0 then 'AVAILABLE' when coverage_pct is null then 'SKIPPED' when coverage_pct >= 50 then 'PASS' else 'FAIL' end from told
  union all select scan_id, 'sonarqube', case when k % 2 = 0 and n % 3 = 0 then 'ERROR' when k % 2 = 0 and n % 3 = 1 then 'OK' when k % 3 = 0 then 'LOCAL_ANALYSIS' else 'SKIPPED' end from told
  union all select scan_id, 'trivy', case when critical is null then 'SKIPPED' when critical = 0 then 'PASS' else 'FAIL' end from told
  union all select scan_id, 'secrets', case when secrets is null then 'SKIPPED' when secrets = 0 then 'PASS' else 'FAIL' end from told
  union all select scan_id, 'sbom', case when k % 7 < 5 and n > 0 then 'GENERATED' else 'SKIPPED' end from told
  union all select scan_id, 'other', case when lint_issues is null then 'SKIPPED' else 'SCANNED' end from told)
"""


@query(
    "report_sections",
    "A19",
    f"""with {REPORT_SECTIONS_SQL} select * from report_sections""",
)
def sections(spark, sf):
    return totals.report_sections(report_facts(spark, sf), coverage_threshold=50.0)


@query(
    "package_coverage",
    "A20",
    f"""with {b.COVERAGE_SQL}, p as (
      select scan_id, file, 0 as pos, adapter as package, {ingest.RATE_SQL} as line_pct from counts
      union all select scan_id, file, 1, 'rest', 50.0::double from counts)
    select scan_id, row_number() over (partition by scan_id order by file, pos) as place, package, line_pct from p
    qualify row_number() over (partition by scan_id order by file, pos) <= 20""",
)
def packages(spark, sf):
    rows = tc.package_rates(tc.read_cobertura(ingest.cobertura_files(spark, sf)))
    first = first_per_key(rows, ["scan_id"], ["file", "pos"], 20, rank="place")
    return first.select("scan_id", F.col("place").cast("bigint").alias("place"), "package", "line_pct")


@query(
    "quality_metrics",
    "A21",
    f"""with {b.FINDINGS_SQL}, {b.COVERAGE_SQL}, m as (
      select scan_id, 'bandit_total' as metric, count(*)::double as value from findings group by scan_id
      union all select scan_id, 'coverage_pct', min({ingest.RATE_SQL}) from counts group by scan_id
      union all select 'scan-' || json_extract_string(props, '$.k'), 'eslint_errors', sum(trunc(value % 7))::double from events group by 1)
    select scan_id, string_agg(metric || '=' || format('{{:.1f}}', value), ',' order by metric) as metrics from m group by scan_id""",
)
def metrics(spark, sf):
    cob = tc.read_cobertura(ingest.cobertura_files(spark, sf)).groupBy("scan_id").agg(F.min("line_pct").alias("value"))
    tables = {
        "bandit_total": lint.read_bandit(ingest.bandit_files(spark, sf)).withColumnRenamed("total", "value"),
        "eslint_errors": lint.read_eslint(ingest.eslint_files(spark, sf)).withColumnRenamed("errors", "value"),
        "coverage_pct": cob,
    }
    rows = totals.quality_metrics(tables)
    shown = F.transform(F.sort_array(F.map_entries("metrics")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.1f", e["value"])))
    return rows.select("scan_id", F.array_join(shown, ",").alias("metrics"))


@query(
    "facet_counts",
    "A22",
    f"""with {b.FINDINGS_SQL}
    select 'severities' as facet, severity as value, count(*) as n from leveled group by severity
    union all select 'types', kind, count(*) from leveled group by kind""",
)
def facets(spark, sf):
    rows = b.findings(spark, sf).select(normalize_severity("severity_raw").alias("severity"), F.col("kind").alias("type"))
    return totals.facet_counts(rows)


@query(
    "sbom_distinct_components",
    "A8",
    f"""with {b.COMPONENTS_SQL}, c as (select *, 'pkg:generic/' || name || '@' || version as purl from components)
    select scan_id, count(*) as components, count(distinct purl) as distinct_components from c group by scan_id""",
)
def sbom_distinct(spark, sf):
    rows = totals.distinct_components(components.read_sbom(b.sbom_files(spark, sf)), b.component_partitions(spark, sf))
    return rows.select("scan_id", "components", "distinct_components")


@query(
    "sbom_distinct_windows",
    "A8",
    f"""with {b.COMPONENTS_SQL}, c as (select *, 'pkg:generic/' || name || '@' || version as purl, cast(substr(scan_id, 5) as bigint) % 16 as part16 from components)
    select part16, count(distinct scan_id) as scans, count(distinct purl) as exact_components, 'true' as close from c group by 1""",
)
def sbom_windows(spark, sf):
    """Sixteen groups of inventories merged from stored sketches, within five standard deviations of the exact count."""
    parts = b.component_partitions(spark, sf)
    counts = staged(totals.component_counts(components.read_sbom(b.sbom_files(spark, sf)), parts), "component-counts")
    part = (F.substring("scan_id", 5, 20).cast("bigint") % 16).alias("part16")
    sketches = staged(totals.components_of_scans(counts, parts), "component-sketches")
    merged = totals.merged_components(sketches.select(part, "sketch"), "part16")
    exact = counts.groupBy(part).agg(F.countDistinct("purl").alias("exact_components"))
    close = F.abs(F.col("distinct_estimate") - F.col("exact_components")) <= F.col("exact_components") * (5 * 1.04 / 2 ** (totals.SKETCH_BITS / 2))
    return merged.join(exact, "part16").select("part16", "scans", "exact_components", close.cast("string").alias("close"))
