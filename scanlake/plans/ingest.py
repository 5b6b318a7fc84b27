"""Queries over sources: report text in, rows out."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake import sinks
from scanlake.functions.numbers import one_digit_text
from scanlake.operators import gates
from scanlake.operators.totals import severity_totals
from scanlake.plans import bindings as b
from scanlake.plans.registry import query
from scanlake.session import shared_dir
from scanlake.sources import artifacts, components, lint, quality, scanners, textual, tests_coverage as tc


@query(
    "severity_gate_from_reports",
    "S2 S3 P1 A1 G3",
    f"""with {b.FINDINGS_SQL}
    select scan_id, count(*) filter (kind in ('vuln','misconfig') and severity = 'CRITICAL') as critical,
      count(*) filter (kind in ('vuln','misconfig') and severity = 'HIGH') as high,
      count(*) filter (kind in ('vuln','misconfig') and severity = 'MEDIUM') as medium,
      count(*) filter (kind in ('vuln','misconfig') and severity = 'LOW') as low,
      count(*) filter (kind in ('vuln','misconfig') and severity = 'UNKNOWN') as unknown,
      count(*) filter (kind = 'secret') as secrets,
      case when count(*) filter (kind in ('vuln','misconfig') and severity = 'CRITICAL') > 0 then 'FAIL'
        when count(*) filter (kind in ('vuln','misconfig') and severity = 'HIGH') > 0 then 'WARN' else 'PASS' end as status
    from leveled group by scan_id""",
)
def severity_gate_from_reports(spark, sf):
    """Flagship: report files to one verdict per scan."""
    counts = severity_totals(scanners.finding_counts(b.vuln_reports(spark, sf)), policy="api")
    return counts.select(
        "scan_id", "critical", "high", "medium", "low", "unknown", "secrets", gates.tri_state().alias("status")
    )


@query(
    "read_artifacts",
    "S1",
    "select source as scan_id, cast(sum(strlen(text) + 1) as bigint) as bytes from documents group by source",
)
def read_artifacts(spark, sf):
    root = shared_dir(spark, "artifacts")
    docs = b.table(spark, sf, "documents").select("source", F.col("text").alias("value"))
    sinks.write_documents(docs, root, "reports", "source")
    found = artifacts.read_artifacts(spark, f"{root}/reports", "*.txt")
    return found.groupBy("scan_id").agg(F.sum("length").alias("bytes"))


@query(
    "read_report_lines",
    "S1",
    r"""select source as scan_id, cast(sum(len(string_split(regexp_replace(text, '\n$', ''), chr(10)))) as bigint) as lines
    from documents group by source""",
)
def read_report_lines(spark, sf):
    root = shared_dir(spark, "artifacts")
    docs = b.table(spark, sf, "documents").select("source", F.regexp_replace("text", r"\n$", "").alias("value"))
    sinks.write_documents(docs, root, "reports", "source")
    found = artifacts.read_report_lines(spark, f"{root}/reports", "*.txt")
    return found.groupBy("scan_id").agg(F.count("*").alias("lines"))


@query(
    "read_vuln_reports",
    "S2",
    f"""with {b.FINDINGS_SQL}
    select scan_id, count(distinct file || (ord // {b.FILE_SPAN}) || target) as files,
      count(distinct file || (ord // {b.FILE_SPAN}) || target) filter (scan_id not like '%7') as readable
    from findings group by scan_id""",
)
def read_vuln_reports(spark, sf):
    """Scans whose id ends in 7 have cut-off files: they are counted but not readable."""
    reports = b.vuln_reports(spark, sf)
    broken = F.when(F.col("scan_id").endswith("7"), F.expr("left(content, length(content) - 2)")).otherwise(F.col("content"))
    parsed = scanners.read_vuln_reports(reports.withColumn("content", broken))
    return parsed.groupBy("scan_id").agg(F.count("*").alias("files"), F.count_if("well_formed").alias("readable"))


@query(
    "flatten_vulnerabilities",
    "S3 P8",
    f"""with {b.FINDINGS_SQL}
    select scan_id, severity, id, package, installed, fixed, target,
      case when length(title) > 120 then substr(title, 1, 117) || '...' else title end as title
    from leveled where kind = 'vuln'""",
)
def flatten_vulnerabilities(spark, sf):
    rows = scanners.flatten_vulnerabilities(scanners.read_vuln_reports(b.vuln_reports(spark, sf)))
    return rows.select("scan_id", "severity", "id", "package", "installed", "fixed", "target", "title")


@query(
    "flatten_misconfigurations",
    "S4",
    f"""with {b.FINDINGS_SQL}
    select scan_id, severity, id, package, substr(title, 1, 80) as fixed, target, substr(title, 1, 120) as title
    from leveled where kind = 'misconfig'""",
)
def flatten_misconfigurations(spark, sf):
    rows = scanners.flatten_misconfigurations(scanners.read_vuln_reports(b.vuln_reports(spark, sf)))
    return rows.select("scan_id", "severity", "id", "package", "fixed", "target", "title")


@query(
    "flatten_secrets",
    "S5",
    f"""with {b.FINDINGS_SQL}
    select scan_id, severity_high as severity, id, package, title, target, cast(line as bigint) as line
    from leveled where kind = 'secret'""",
)
def flatten_secrets(spark, sf):
    rows = scanners.flatten_secrets(scanners.read_vuln_reports(b.vuln_reports(spark, sf)))
    return rows.select("scan_id", "severity", "id", "package", "title", "target", F.col("line").cast("bigint").alias("line"))


@query(
    "read_sbom",
    "S6",
    f"""with {b.COMPONENTS_SQL}
    select scan_id, 'sbom-' || part || '.json' as file, 'CycloneDX' as format, '1.4' as spec, type, name, version,
      'pkg:generic/' || name || '@' || version as purl from components""",
)
def read_sbom(spark, sf):
    return components.read_sbom(b.sbom_files(spark, sf)).drop("has_component")


@query(
    "read_junit",
    "S7",
    f"""with {b.LABELLED_SQL}
    select scan_id, 'TEST-' || part || '.xml' as file, count(*) as tests, count(*) filter (quality = 0) as failures,
      count(*) filter (toxic = 1) as errors, cast(1 as bigint) as skipped, cast(count(*) as bigint) as cases
    from labelled group by scan_id, part""",
)
def read_junit(spark, sf):
    rows = tc.read_junit(b.junit_files(spark, sf))
    return rows.select(
        "scan_id", "file", "tests", "failures", "errors", "skipped", F.size("cases").cast("bigint").alias("cases")
    )


@query(
    "failed_test_cases",
    "S7",
    f"""with {b.LABELLED_SQL}
    select scan_id, 'FAILED: ' || source || '.d' || doc_id as title, 'low quality' as detail
    from labelled where quality = 0""",
)
def failed_test_cases(spark, sf):
    return tc.failed_cases(tc.read_junit(b.junit_files(spark, sf))).select("scan_id", "title", "detail")


def cobertura_files(spark, sf):
    """One package per adapter and report; the rate is spelt with six digits."""
    c = b.coverage_counts(spark, sf)
    rate = F.format_string("%.6f", F.col("covered") / F.col("total"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><!DOCTYPE coverage SYSTEM "coverage.dtd"><coverage line-rate="'), rate,
        F.lit('" branch-rate="0.25" lines-covered="'), F.col("covered").cast("string"), F.lit('" lines-valid="'),
        F.col("total").cast("string"), F.lit('"><packages><package name="'), F.col("adapter"),
        F.lit('" line-rate="'), rate, F.lit('"/><package name="rest" line-rate="0.5"/></packages></coverage>'),
    )
    return c.select("scan_id", "adapter", "file", xml.alias("content"))


RATE_SQL = "cast(format('{:.1f}', cast(format('{:.6f}', covered / total) as double) * 100.0) as double)"


@query(
    "read_cobertura",
    "S8 P13",
    f"""with {b.COVERAGE_SQL}
    select scan_id, file, {RATE_SQL} as line_pct, 25.0::double as branch_pct,
      cast(covered as varchar) as lines_covered, cast(total as varchar) as lines_valid from counts""",
)
def read_cobertura(spark, sf):
    return tc.read_cobertura(cobertura_files(spark, sf)).drop("packages")


def jacoco_files(spark, sf):
    """Method, class and report counters; attribute order differs between them."""
    c = b.coverage_counts(spark, sf)
    missed = F.col("total") - F.col("covered")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><!DOCTYPE report PUBLIC "-//JACOCO//DTD" "report.dtd"><report><package><class><method>'
              '<counter type="INSTRUCTION" missed="9" covered="9"/><counter type="LINE" missed="'),
        missed.cast("string"), F.lit('" covered="0"/></method></class></package><counter covered="'),
        F.col("covered").cast("string"), F.lit('" missed="'), missed.cast("string"), F.lit('" type="LINE"/></report>'),
    )
    return c.select("scan_id", "adapter", "file", xml.alias("content"))


for _mode, _missed, _covered in (
    ("first", "total - covered", "0"),
    ("last", "total - covered", "covered"),
    ("sum", "2 * (total - covered)", "covered"),
):
    _sum = f"({_missed} + {_covered})"

    @query(
        f"read_jacoco_{_mode}",
        "S9",
        f"""with {b.COVERAGE_SQL}
        select scan_id, file, cast({_missed} as bigint) as missed, cast({_covered} as bigint) as covered,
          case when {_sum} = 0 then 0.0::double else {b.sql_pct(_covered, _sum)} end as line_pct from counts""",
    )
    def read_jacoco(spark, sf, mode=_mode):
        return tc.read_jacoco(jacoco_files(spark, sf), mode)


def lcov_files(spark, sf):
    """Each adapter's report has two source records; the second one repeats the counts."""
    c = b.coverage_counts(spark, sf)
    record = F.concat(F.lit("SF:a\nLF:"), F.col("total").cast("string"), F.lit("\nLH:"), F.col("covered").cast("string"))
    return c.select("scan_id", "adapter", "file", F.concat(record, F.lit("\nend_of_record\n"), record).alias("content"))


@query(
    "read_lcov",
    "S10 P13",
    f"""with {b.COVERAGE_SQL}
    select scan_id, file, cast(2 * total as bigint) as lines_found, cast(2 * covered as bigint) as lines_hit,
      {b.sql_pct('2 * covered', '2 * total')} as line_pct from counts""",
)
def read_lcov(spark, sf):
    return tc.read_lcov(lcov_files(spark, sf))


@query(
    "lcov_from_lines",
    "S10",
    f"""with {b.COVERAGE_SQL}
    select scan_id, file as rel_path, cast(2 * total as bigint) as lines_found, cast(2 * covered as bigint) as lines_hit,
      {b.sql_pct('2 * covered', '2 * total')} as line_pct from counts""",
)
def lcov_from_lines(spark, sf):
    lines = lcov_files(spark, sf).select(
        "scan_id", F.col("file").alias("rel_path"), F.explode(F.split("content", "\n")).alias("line")
    )
    return tc.lcov_from_lines(lines)


@query(
    "read_istanbul",
    "S11",
    f"""with {b.COVERAGE_SQL} select scan_id, file, {b.sql_pct('covered', 'total')} as line_pct from counts""",
)
def read_istanbul(spark, sf):
    pct = F.col("covered") / F.col("total") * 100.0
    doc = F.struct(F.struct(F.struct(pct.alias("pct")).alias("lines")).alias("total"))
    files = b.coverage_counts(spark, sf).select("scan_id", "file", F.to_json(doc).alias("content"))
    return tc.read_istanbul(files)


@query(
    "read_go_tests",
    "S12",
    f"""with {b.EVENTS_SQL}
    select 'scan-' || k as scan_id, count(*) filter (event_type <> 'error' and event_type <> 'view') as passed,
      count(*) filter (event_type = 'error') as failed from builds group by k""",
)
def read_go_tests(spark, sf):
    """One NDJSON file per event: its own test event, a package event without a test, and a broken line."""
    kind = F.col("event_type")
    action = F.when(kind == "error", "fail").when(kind == "view", "run").otherwise("pass")
    line = F.to_json(F.struct(action.alias("Action"), F.concat(F.lit("T"), F.col("number").cast("string")).alias("Test")))
    files = b.events(spark, sf).select(
        F.concat(F.lit("scan-"), "k").alias("scan_id"),
        F.concat(line, F.lit('\n{"Action":"pass"}\n{"Action":')).alias("content"),
    )
    return tc.read_go_tests(files)


@query(
    "parse_unittest_log",
    "S13",
    f"""with {b.COVERAGE_SQL}
    select scan_id, file, cast(total as bigint) as total, cast(covered % 5 as bigint) as failed,
      cast(total % 3 as bigint) as errors, cast(greatest(total - covered % 5 - total % 3, 0) as bigint) as passed from counts""",
)
def parse_unittest_log(spark, sf):
    log = F.concat(
        F.repeat(F.lit("FAIL: t\n"), (F.col("covered") % 5).cast("int")),
        F.repeat(F.lit("ERROR: t\n"), (F.col("total") % 3).cast("int")),
        F.lit("Ran "), F.col("total").cast("string"), F.lit(" tests in 0.1s"),
    )
    return tc.parse_unittest_log(b.coverage_counts(spark, sf).select("scan_id", "file", log.alias("content")))


def gate_files(spark, sf):
    """One gate document per language and source: status by the share of toxic documents, half of them unwrapped."""
    rows = b.labelled(spark, sf).groupBy("scan_id", "source").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.count_if(F.col("quality") == 0).alias("low")
    )
    status = F.when(F.col("toxic") > 0, "Error").when(F.col("low") > 1, "warn").when(F.col("low") == 1, "").otherwise("ok")
    condition = F.struct(
        F.lit("toxic").alias("metricKey"), F.col("toxic").cast("string").alias("actualValue"),
        F.lit("0").alias("errorThreshold"), F.when(F.col("toxic") > 0, "ERROR").otherwise("OK").alias("status"),
    )
    wrapped = F.to_json(F.struct(F.struct(status.alias("status"), F.array(condition).alias("conditions")).alias("projectStatus")))
    bare = F.to_json(F.struct(status.alias("status")))
    return rows.select(
        "scan_id", F.concat("source", F.lit(".json")).alias("file"), "n", "toxic", "low",
        F.when(F.col("n") % 2 == 0, bare).otherwise(wrapped).alias("content"),
    )


GATE_FILES_SQL = f"""{b.LABELLED_SQL},
gate_files as (
  select scan_id, source || '.json' as file, count(*) as n, cast(sum(toxic) as bigint) as toxic,
    count(*) filter (quality = 0) as low from labelled group by scan_id, source),
gate_status as (
  select *, case when toxic > 0 then 'ERROR' when low > 1 then 'WARN' when low = 1 then null else 'OK' end as status
  from gate_files)
"""


@query("read_quality_gate", "S14", f"with {GATE_FILES_SQL} select scan_id, file, status from gate_status")
def read_quality_gate(spark, sf):
    return quality.read_quality_gate(gate_files(spark, sf)).drop("conditions")


@query(
    "read_measures",
    "S15",
    f"""with {GATE_FILES_SQL}
    select scan_id, file, cast(toxic as varchar) as bugs, cast(low as varchar) as code_smells, 'N/A' as coverage from gate_files""",
)
def read_measures(spark, sf):
    """A repeated metric: the second value holds."""

    def m(name, value):
        return F.struct(F.lit(name).alias("metric"), value.cast("string").alias("value"))

    measures = F.array(m("bugs", F.lit("0")), m("code_smells", F.col("low")), m("bugs", F.col("toxic")))
    doc = F.struct(F.struct(measures.alias("measures")).alias("component"))
    files = gate_files(spark, sf).select("scan_id", "file", F.to_json(doc).alias("content"))
    return quality.read_measures(files, ("bugs", "code_smells", "coverage"))


def issue_files(spark, sf):
    level = F.col("severity_raw")
    item = F.struct(
        F.when(level == "CRITICAL", "BLOCKER").when(level == "High", "CRITICAL").otherwise(level).alias("severity"),
        F.upper("kind").alias("type"), F.col("title").alias("message"), F.col("target").alias("component"),
        F.col("id").alias("rule"),
    )
    return b.lint_files(spark, sf, item, F.struct(F.col("items").alias("issues")))


@query(
    "read_quality_issues",
    "S16",
    f"""with {b.FINDINGS_SQL}
    select scan_id, count(*) as open_issues, count(*) filter (severity_raw = 'CRITICAL') as blocker,
      count(*) filter (severity_raw = 'High') as critical from findings group by scan_id""",
)
def read_quality_issues(spark, sf):
    return quality.issue_counts(quality.quality_issues(issue_files(spark, sf)))


@query(
    "leading_quality_issues",
    "S16",
    f"""with {b.FINDINGS_SQL}
    select scan_id, row_number() over (partition by scan_id order by ord) as rank,
      case severity_raw when 'CRITICAL' then 'BLOCKER' when 'High' then 'CRITICAL' else coalesce(severity_raw, 'UNKNOWN') end as severity,
      substr(title, 1, 150) as title, target || ': ' || id as detail
    from findings qualify row_number() over (partition by scan_id order by ord) <= 20""",
)
def leading_quality_issues(spark, sf):
    files = issue_files(spark, sf).withColumn("file", F.col("part"))
    rows = quality.leading_issues(quality.quality_issues(files), ("file", "pos"), 20)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


def level_entry():
    """CRITICAL reads error, High warning, the rest info or style."""
    level = F.col("severity_raw")
    return F.when(level == "CRITICAL", "error").when(level == "High", "warning").when(level == "LOW", "style").otherwise("info")


@query(
    "read_shellcheck",
    "S17",
    f"""with {b.FINDINGS_SQL}
    select scan_id, count(*) as total, count(*) filter (severity_raw = 'CRITICAL') as errors,
      count(*) filter (severity_raw = 'High') as warnings from findings group by scan_id""",
)
def read_shellcheck(spark, sf):
    return lint.read_shellcheck(b.lint_files(spark, sf, F.struct(level_entry().alias("level"))))


def hadolint_files(spark, sf):
    """Files of even scans are wrapped in one more list."""
    item = F.struct(
        level_entry().alias("level"), F.col("id").alias("code"), F.col("title").alias("message"),
        F.lit("Dockerfile").alias("file"), F.col("line").alias("line"),
    )
    files = b.lint_files(spark, sf, item)
    wrapped = F.when(F.col("scan_id").rlike("[02468]$"), F.concat(F.lit("["), "content", F.lit("]")))
    return files.withColumn("content", F.coalesce(wrapped, "content"))


@query(
    "read_hadolint",
    "S18",
    f"""with {b.FINDINGS_SQL}
    select scan_id, count(*) as total, count(*) filter (severity_raw = 'CRITICAL') as high,
      count(*) filter (severity_raw = 'High') as medium from findings group by scan_id""",
)
def read_hadolint(spark, sf):
    return lint.read_hadolint(hadolint_files(spark, sf))


@query(
    "read_grype",
    "S19",
    f"""with {b.FINDINGS_SQL}
    select scan_id, coalesce(severity_raw, 'Unknown') as severity, count(*) as n from findings group by all""",
)
def read_grype(spark, sf):
    item = F.struct(F.struct(F.col("severity_raw").alias("severity")).alias("vulnerability"))
    return lint.read_grype(b.lint_files(spark, sf, item, F.struct(F.col("items").alias("matches"))))


def bandit_files(spark, sf):
    item = F.struct(F.upper("severity_raw").alias("issue_severity"))
    return b.lint_files(spark, sf, item, F.struct(F.col("items").alias("results")))


@query(
    "read_bandit",
    "S20",
    f"""with {b.FINDINGS_SQL}
    select scan_id, count(*) as total, count(*) filter (severity_raw = 'High') as high,
      count(*) filter (severity_raw = 'MEDIUM') as medium from findings group by scan_id""",
)
def read_bandit(spark, sf):
    return lint.read_bandit(bandit_files(spark, sf))


def eslint_files(spark, sf):
    """One file entry per event, as a list of two: the counts are split over both."""
    errors = (F.col("value") % 7).cast("int")
    entry = F.array(
        F.struct(errors.alias("errorCount"), F.lit(2).alias("warningCount")),
        F.struct(F.lit(None).cast("int").alias("errorCount"), F.lit(1).alias("warningCount")),
    )
    return b.events(spark, sf).select(F.concat(F.lit("scan-"), "k").alias("scan_id"), F.to_json(entry).alias("content"))


@query(
    "read_eslint",
    "S21",
    f"""with {b.EVENTS_SQL}
    select 'scan-' || k as scan_id, cast(sum(trunc(value % 7)) as bigint) as errors, cast(sum(3) as bigint) as warnings
    from builds group by k""",
)
def read_eslint(spark, sf):
    return lint.read_eslint(eslint_files(spark, sf))


def text_reports(spark, sf):
    """Document texts as line-per-issue reports, a blank line put in front."""
    return b.table(spark, sf, "documents").select(
        F.col("source").alias("scan_id"), F.concat(F.lit("\n"), "text").alias("content")
    )


@query(
    "count_text_issues_all",
    "S22",
    r"""select source as scan_id, cast(sum(1 + len(string_split(regexp_replace(text, '\n$', ''), chr(10)))) as bigint) as issues
    from documents group by source""",
)
def count_text_issues_all(spark, sf):
    return lint.count_text_issues(text_reports(spark, sf), blank=True)


@query(
    "count_text_issues_nonblank",
    "S22",
    r"""select source as scan_id, cast(sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))) as bigint) as issues
    from documents group by source""",
)
def count_text_issues_nonblank(spark, sf):
    return lint.count_text_issues(text_reports(spark, sf), blank=False)


@query(
    "extract_score",
    "S23",
    f"""with {b.COVERAGE_SQL}
    select scan_id, file, case when adapter = 'N' then null else {b.sql_pct('covered', 'total')} / 10 end as score from counts""",
)
def extract_score(spark, sf):
    pct = one_digit_text(F.col("covered") / F.col("total") * 100.0).cast("double") / 10
    text = F.when(F.col("adapter") == "N", "no score").otherwise(
        F.concat(F.lit("Your code has been rated at "), F.format_string("%.2f", pct), F.lit("/10"))
    )
    rows = b.coverage_counts(spark, sf).select("scan_id", "file", text.alias("content"))
    return lint.extract_score(rows).drop("content")


def gate_value_files(spark, sf):
    """Gate files from the per-scan totals; the first line is given twice, and one value holds a sign."""
    counts = severity_totals(b.findings(spark, sf), policy="gate")
    text = F.concat(
        F.lit("CRITICAL_VULNS=-1\n# note\n CRITICAL_VULNS = "), F.col("critical").cast("string"),
        F.lit("\nSECRETS="), F.col("secrets").cast("string"), F.lit("\nURL=a=b"),
    )
    return counts.select("scan_id", F.lit("gate-results.txt").alias("file"), text.alias("content"), "critical", "secrets")


@query(
    "parse_key_values",
    "S24",
    f"""with {b.FINDINGS_SQL}, g as (
      select scan_id, count(*) filter (kind = 'vuln' and severity = 'CRITICAL') as c, count(*) filter (kind = 'secret') as s
      from leveled group by scan_id)
    select scan_id, 'CRITICAL_VULNS' as key, cast(c as varchar) as value from g
    union all select scan_id, 'SECRETS', cast(s as varchar) from g union all select scan_id, 'URL', 'a=b' from g""",
)
def parse_key_values(spark, sf):
    return textual.parse_key_values(gate_value_files(spark, sf)).drop("file")


def summary_documents(spark, sf):
    """Pipeline summaries of the per-scan totals, secret detection among the types."""
    counts = severity_totals(b.findings(spark, sf), policy="summary").withColumn(
        "gate_status", gates.critical_or_secret()
    )

    def entry(**fields):
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    doc = F.struct(
        "scan_id",
        "gate_status",
        (F.col("gate_status") == "PASS").alias("gate_passed"),
        sinks.counters().alias("totals"),
        F.col("secrets").alias("secrets_found"),
        F.struct(
            entry(critical=F.col("critical"), high=F.col("high"), medium=F.lit(0), low=F.lit(0), unknown=F.lit(0)).alias("SAST"),
            entry(found=F.col("secrets"), file=F.lit("secret-scan.json")).alias("Secret Detection"),
        ).alias("findings_by_scan"),
    )
    return counts.select("scan_id", F.to_json(doc).alias("content"))


SUMMARY_SQL = f"""{b.FINDINGS_SQL}, t as (
  select scan_id, count(*) filter (kind <> 'secret' and severity = 'CRITICAL') as critical,
    count(*) filter (kind <> 'secret' and severity = 'HIGH') as high,
    count(*) filter (kind <> 'secret' and severity = 'MEDIUM') as medium,
    count(*) filter (kind <> 'secret' and severity = 'LOW') as low,
    count(*) filter (kind <> 'secret' and severity = 'UNKNOWN') as unknown,
    count(*) filter (kind = 'secret') as secrets from leveled group by scan_id)
"""


@query(
    "read_scan_summary",
    "S25",
    f"""with {SUMMARY_SQL}
    select scan_id, case when critical > 0 or secrets > 0 then 'false' else 'true' end as gate_passed, critical, high, medium, low, unknown,
      secrets as secrets_found, cast(null as bigint) as sbom_component_count, 'SAST' as types from t""",
)
def read_scan_summary(spark, sf):
    rows = textual.read_scan_summary(summary_documents(spark, sf))
    return rows.select(
        "scan_id", F.col("gate_passed").cast("string").alias("gate_passed"), "critical", "high", "medium", "low", "unknown",
        "secrets_found", "sbom_component_count",
        F.array_join(F.sort_array(F.map_keys("findings_by_type")), ",").alias("types"),
    )


@query(
    "read_unified_report",
    "S25",
    f"""with {SUMMARY_SQL}
    select scan_id, case when critical > 0 then 'false' else 'true' end as gate_passed, critical, high, cast(0 as bigint) as medium,
      'UNAVAILABLE' as quality_gate from t""",
)
def read_unified_report(spark, sf):
    counts = severity_totals(b.findings(spark, sf), policy="summary")
    doc = F.struct(
        F.struct(
            F.struct(gates.critical_only().alias("status")).alias("gate_verdict"),
            F.struct(F.col("critical").alias("CRITICAL"), F.col("high").alias("HIGH")).alias("severity_totals"),
            F.create_map(F.lit("sonar-scanner"), F.struct(F.lit(False).alias("available"))).alias("tool_status"),
        ).alias("summary")
    )
    rows = textual.read_unified_report(counts.select("scan_id", F.to_json(doc).alias("content")))
    return rows.select("scan_id", F.col("gate_passed").cast("string").alias("gate_passed"), "critical", "high", "medium", "quality_gate")


@query(
    "lockfile_components",
    "S26 P12",
    f"""with {b.COMPONENTS_SQL}
    select distinct scan_id, 'library' as type, name || '-' || ord as name, version,
      'pkg:npm/' || name || '-' || ord || '@' || version as purl from components""",
)
def lockfile_components(spark, sf):
    """Lock maps keyed by install path, with the project's own empty key; odd ranges use the older field."""
    rows = b.components(spark, sf)
    key = F.concat(F.lit("node_modules/"), "name", F.lit("-"), F.col("ord").cast("string"))
    packed = b._bom_files(rows, F.struct(key.alias("key"), F.struct("version").alias("value")), once=True)
    entries = F.concat(F.array(F.struct(F.lit("").alias("key"), F.struct(F.lit("0").alias("version")).alias("value"))), "items")
    lock = F.map_from_entries(entries)
    doc = F.when(F.col("part") % 2 == 0, F.to_json(F.struct(lock.alias("packages")))).otherwise(
        F.to_json(F.struct(lock.alias("dependencies")))
    )
    return components.lockfile_components(packed.select("scan_id", "file", doc.alias("content"))).drop("file")


@query(
    "manifest_components",
    "S26",
    f"""with {b.COMPONENTS_SQL}
    select distinct scan_id, name || '-' || ord as name, version, 'pkg:npm/' || name || '-' || ord || '@' || version as purl
    from components""",
)
def manifest_components(spark, sf):
    rows = b.components(spark, sf)
    key = F.concat("name", F.lit("-"), F.col("ord").cast("string"))
    packed = b._bom_files(rows, F.struct(key.alias("key"), F.concat(F.lit("^~>="), "version").alias("value")), once=True)
    doc = F.struct(F.map_from_entries("items").alias("devDependencies"))
    files = packed.select("scan_id", "file", F.to_json(doc).alias("content"))
    return components.manifest_components(files).drop("file", "type")


@query(
    "gosum_components",
    "S27",
    f"""with {b.COMPONENTS_SQL}
    select distinct scan_id, part, replace(name, ' ', '_') as name, version, 'pkg:golang/' || replace(name, ' ', '_') || '@' || version as purl
    from components""",
)
def gosum_components(spark, sf):
    """Two lines per component, the second one for its module file."""
    name = F.replace("name", F.lit(" "), F.lit("_"))
    lines = F.concat(name, F.lit(" v"), "version", F.lit(" h1:x=\n"), name, F.lit(" v"), "version", F.lit("/go.mod h1:y="))
    packed = b._bom_files(b.components(spark, sf), lines)
    files = packed.select("scan_id", "part", "file", F.array_join("items", "\n").alias("content"))
    rows = components.gosum_components(files)
    part = F.regexp_extract("file", r"(\d+)", 1).cast("bigint")
    return rows.select("scan_id", part.alias("part"), "name", "version", "purl")


def catalog(spark, sf):
    region = b.table(spark, sf, "region")
    nation = b.table(spark, sf, "nation")
    repositories = region.select(F.to_json(F.struct(F.array("r_name").alias("repositories"))).alias("content"))
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    tags = joined.select(F.col("r_name").alias("repo"), F.to_json(F.struct(F.array("n_name").alias("tags"))).alias("content"))
    no_tags = region.select(F.col("r_name").alias("repo"), F.lit('{"tags":null}').alias("content"))
    return repositories, tags.unionByName(no_tags)


@query(
    "expand_image_catalog",
    "S28",
    """select r_name as repo, n_name as tag, 'registry.local:5000/' || r_name || ':' || n_name as image
    from nation join region on n_regionkey = r_regionkey""",
)
def expand_image_catalog(spark, sf):
    return components.expand_image_catalog(*catalog(spark, sf), "registry.local:5000")


@query(
    "grep_report_totals",
    "S29",
    f"""with {SUMMARY_SQL}
    select scan_id, critical, high, medium, secrets, cast(0 as bigint) as misconfigs from t""",
)
def grep_report_totals(spark, sf):
    counts = severity_totals(b.findings(spark, sf), policy="summary")

    def line(label, name):
        return F.concat(F.lit(f"{label}:   "), F.col(name).cast("string"), F.lit("\n"))

    text = F.concat(
        line("CRITICAL Vulnerabilities", "critical"), line("HIGH Vulnerabilities", "high"),
        line("MEDIUM Vulnerabilities", "medium"), line("Secrets Detected", "secrets"),
    )
    return textual.grep_report_totals(counts.select("scan_id", text.alias("content")))


@query(
    "parse_agent_list",
    "S30",
    f"""with {b.EVENTS_SQL}
    select 'scan-agent-' || number as name, case when event_type in ('view', 'signup') then 'true' else 'false' end as online from builds""",
)
def parse_agent_list(spark, sf):
    """One listing per event: a title, the agent with its state (or without one), a footer."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "  online").when(kind == "signup", "\tONLINE").when(kind == "error", "  OFFLINE").otherwise("")
    text = F.concat(F.lit("Agents\n  scan-agent-"), F.col("number").cast("string"), state, F.lit("\nTotal: 1"))
    rows = textual.parse_agent_list(b.events(spark, sf).select(text.alias("content")))
    return rows.select("name", F.col("online").cast("string").alias("online"))
