"""Queries over summaries, lookups, rankings, set operations and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake import sinks
from scanlake.functions.severity import normalize_severity
from scanlake.operators.dedupe import dedupe_findings
from scanlake.operators import gates, inventory, joins, ranking, summaries, totals
from scanlake.plans import bindings as b
from scanlake.plans import counting, ingest, verdicts
from scanlake.plans.registry import query
from scanlake.session import shared_dir, staged
from scanlake.sources import artifacts, lint, quality, scanners, textual, tests_coverage as tc

COUNTS = counting.COUNTS
SUM_COUNTS = ", ".join(f"cast(sum({n}) as bigint) as {n}" for n in COUNTS)


def summary_rows(spark, sf):
    """Scans with their totals, types, secrets, inventory count, quality gate and gate verdict."""
    f = b.findings(spark, sf)
    scans = b.table(spark, sf, "customer").select(F.concat(F.lit("scan-"), F.col("c_custkey").cast("string")).alias("scan_id"))
    total = joins.scan_totals(totals.severity_totals(f, ("scan_id", "report"), "api"))
    gate = verdicts.gate_texts(spark, sf).select("scan_id", "gate_text")
    sbom = b.coverage_counts(spark, sf).groupBy("scan_id").agg(F.sum("total").alias("sbom_component_count"))
    rows = joins.scan_summary(scans, {"totals": total, "sbom": sbom, "gate": gate})
    return rows.withColumn("gate_passed", gates.from_gate_file())


SUMMARY_SQL = f"""{counting.CHECKS_SQL}, c as (
  select scan_id, report, {counting.sql_counts()} from leveled where kind <> 'secret' group by scan_id, report),
tot as (select scan_id, {SUM_COUNTS},
  string_agg(report || ':' || critical || '/' || high || '/' || medium || '/' || low || '/' || unknown, ',' order by report) as types from c group by scan_id),
sec as (select scan_id, count(*) filter (kind = 'secret') as secrets from findings group by scan_id),
sb as (select 'scan-' || l_suppkey as scan_id, count(*) as sbom_component_count from lineitem group by l_suppkey),
gt as (select scan_id, case when right(scan_id, 1) in ('0','1','2') then critical = 0 when right(scan_id, 1) in ('3','4','5') then true
  when right(scan_id, 1) in ('6','7') then secrets <= 3 end as by_file from checks),
summary as (
  select 'scan-' || c_custkey as scan_id, case when sec.secrets is null then null else coalesce(tot.critical, 0) end as critical, case when sec.secrets is null then null else coalesce(tot.high, 0) end as high,
    case when sec.secrets is null then null else coalesce(tot.medium, 0) end as medium, case when sec.secrets is null then null else coalesce(tot.low, 0) end as low,
    case when sec.secrets is null then null else coalesce(tot.unknown, 0) end as unknown, coalesce(tot.types, '') as types, sec.secrets, sb.sbom_component_count,
    case when by_file is null then coalesce(tot.critical, 0) = 0 else by_file end as gate_passed
  from customer left join tot on tot.scan_id = 'scan-' || c_custkey left join sec on sec.scan_id = 'scan-' || c_custkey
  left join sb on sb.scan_id = 'scan-' || c_custkey left join gt on gt.scan_id = 'scan-' || c_custkey)
"""


def show_types(col="findings_by_type"):
    entry = F.transform(
        F.sort_array(F.map_entries(col)),
        lambda e: F.concat(e["key"], F.lit(":"), F.concat_ws("/", *[e["value"][n].cast("string") for n in COUNTS])),
    )
    return F.array_join(entry, ",")


@query(
    "scan_summary",
    "J1 A2",
    f"""with {SUMMARY_SQL}
    select scan_id, critical, high, medium, low, unknown, types, secrets, sbom_component_count, cast(gate_passed as varchar) as gate_passed from summary""",
)
def scan_summary(spark, sf):
    return summary_rows(spark, sf).select(
        "scan_id", *COUNTS, F.coalesce(show_types(), F.lit("")).alias("types"), "secrets", "sbom_component_count",
        F.col("gate_passed").cast("string").alias("gate_passed"),
    )


def report_names(spark, sf):
    """Report files of a scan: the quarter picks the kind, the status which of the accepted names it has."""
    kinds = {"sast": "sast", "image": "image", "k8s": "k8s", "sca": "shellcheck"}
    expr = None
    for report, kind in kinds.items():
        names = joins.PREFERRED_FILES[kind]
        name = F.when(F.col("kind") == "vuln", names[0]).when(F.col("kind") == "misconfig", names[1]).otherwise("other.json")
        hit = F.col("report") == report
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return b.findings(spark, sf).select("scan_id", expr.alias("file")).distinct()


@query(
    "pick_first_present",
    "J2",
    f"""with {b.FINDINGS_SQL}, n as (
      select distinct scan_id, case report when 'sca' then 'shellcheck' else report end as kind, kind as k from findings where kind <> 'secret')
    select scan_id, kind, case when bool_or(k = 'vuln') then case kind when 'sast' then 'trivy-fs-scan.json' when 'image' then 'trivy-image-scan.json'
        when 'k8s' then 'trivy-k8s-scan.json' else 'shellcheck.json' end
      else case kind when 'sast' then 'trivy-fs.json' when 'image' then 'trivy-image.json' when 'k8s' then 'trivy-k8s-config.json' else 'shellcheck-report.json' end end as file
    from n group by scan_id, kind""",
)
def pick_first(spark, sf):
    return joins.pick_first_present(report_names(spark, sf))


@query(
    "source_precedence",
    "J3 S25",
    f"""with {ingest.SUMMARY_SQL}
    select scan_id, case when scan_id like '%0' or scan_id like '%1' then 'summary' when scan_id like '%2' or scan_id like '%1' then 'unified' else 'raw' end as source,
      critical, case when scan_id like '%2' then null else secrets end as secrets from t where scan_id not like '%1'
    union all select scan_id, 'unified', critical, null from t where scan_id like '%1'""",
)
def precedence(spark, sf):
    """Summaries exist for scans ending in 0 and 1 (the latter cut off), local reports for 1 and 2; the rest is raw."""
    counts = totals.severity_totals(b.findings(spark, sf), policy="summary")
    last = F.substring("scan_id", -1, 1)
    doc = F.to_json(F.struct(F.struct("critical").alias("totals"), F.col("secrets").alias("secrets_found")))
    cut = F.when(last == "1", F.expr("'{'")).otherwise(doc)
    summary = counts.where(last.isin("0", "1")).select("scan_id", cut.alias("content"))
    unified_doc = F.to_json(F.struct(F.struct(F.struct(F.col("critical").alias("CRITICAL")).alias("severity_totals")).alias("summary")))
    unified = counts.where(last.isin("1", "2")).select("scan_id", unified_doc.alias("content"))
    usable = artifacts.non_empty_object("content")
    sources = [
        textual.read_scan_summary(summary).join(summary, "scan_id").select(
            "scan_id", F.lit("summary").alias("source"), "critical", F.col("secrets_found").alias("secrets"), usable.alias("usable")
        ),
        textual.read_unified_report(unified).join(unified, "scan_id").select(
            "scan_id", F.lit("unified").alias("source"), "critical", F.col("secrets_found").alias("secrets"), usable.alias("usable")
        ),
        counts.select("scan_id", F.lit("raw").alias("source"), "critical", "secrets", F.lit(True).alias("usable")),
    ]
    return joins.source_precedence(sources).select("scan_id", "source", "critical", "secrets")


@query(
    "scan_summary_from_files",
    "J1 J2 J3 A2 A4 A6 A23 G7",
    f"""with {b.FINDINGS_SQL}, {b.REPORT_FOLDERS_SQL}
    select scan_id, source, case source when 'summary' then k when 'unified' then 0 else critical end::bigint as critical, case source when 'summary' then k + 1 when 'unified' then k else high end::bigint as high,
      case source when 'raw' then medium else 0 end::bigint as medium, case source when 'raw' then low else 0 end::bigint as low, case source when 'raw' then unknown else 0 end::bigint as unknown,
      case source when 'summary' then 'SAST:' || k || '/' || (k + 1) || '/0/0/0' when 'unified' then 'trivy-fs:0/0/0/' || k || '/0' else types end as types,
      case source when 'summary' then 7 when 'raw' then secrets end::bigint as secrets, case when source = 'raw' then components end::bigint as sbom_component_count,
      case source when 'unified' then case when k % 4 = 2 then 'AVAILABLE' else 'UNAVAILABLE' end when 'raw' then case when k % 2 = 0 then 'OK' end end as quality_gate,
      cast(case source when 'summary' then k % 20 = 1 when 'unified' then k % 4 = 2 else case k % 5 when 0 then false when 1 then true when 2 then false when 3 then true else critical = 0 end end as varchar) as gate_passed
    from whole""",
)
def summary_from_files(spark, sf):
    """From report folders to summaries in one chain; each file is parsed once."""
    rows = summaries.scan_summary_from_files(b.report_folders(spark, sf))
    return rows.select(
        "scan_id", "source", *COUNTS, F.coalesce(show_types(), F.lit("")).alias("types"), "secrets", "sbom_component_count", "quality_gate",
        F.col("gate_passed").cast("string").alias("gate_passed"),
    )


@query(
    "registry_report_types",
    "J1 J2",
    f"""with {b.FINDINGS_SQL}, {b.REPORT_FOLDERS_SQL}
    select scan_id, report, critical::bigint as critical, high::bigint as high, medium::bigint as medium, low::bigint as low, unknown::bigint as unknown from by_type""",
)
def registry_types(spark, sf):
    """Finding types as rows: the fixed ones, and one for each registry image."""
    return summaries.report_types(summaries.file_facts(b.report_folders(spark, sf))).select("scan_id", "report", *COUNTS)


@query(
    "resolve_scan_dir",
    "J4",
    """with d as (select distinct 'scan-' || o_custkey || case o_orderstatus when 'O' then '' else '-' || lower(o_orderstatus) end as folder from orders),
    r as (select 'scan-' || c_custkey as requested from customer union all select 'run-' || s_suppkey from supplier),
    m as (select requested, bool_or(folder = requested) as exact, max(folder) as greatest from r left join d on starts_with(folder, requested) group by requested)
    select requested, case when exact then requested else coalesce(greatest, 'legacy') end as folder,
      case when exact then 'exact' when greatest is not null then 'prefix' else 'legacy' end as how from m""",
)
def resolve_dir(spark, sf):
    status = F.lower("o_orderstatus")
    folders = b.table(spark, sf, "orders").select(
        F.concat(
            F.lit("scan-"), F.col("o_custkey").cast("string"),
            F.when(F.col("o_orderstatus") == "O", "").otherwise(F.concat(F.lit("-"), status)),
        ).alias("folder")
    ).distinct()
    requests = b.table(spark, sf, "customer").select(F.concat(F.lit("scan-"), F.col("c_custkey").cast("string")).alias("requested"))
    unknown = b.table(spark, sf, "supplier").select(F.concat(F.lit("run-"), F.col("s_suppkey").cast("string")).alias("requested"))
    return joins.resolve_scan_dir(requests.unionByName(unknown), folders, "legacy")


@query(
    "trace_findings",
    "J8",
    f"""with {b.FINDINGS_SQL}
    select ord, scan_id, 'security:' || tool as trace_key, case tool when 'trivy-config' then null else scan_id || '/security/' || tool || '.json' end as artifact from findings""",
)
def trace(spark, sf):
    scans = b.table(spark, sf, "customer").select(F.concat(F.lit("scan-"), F.col("c_custkey").cast("string")).alias("scan_id"))
    written = joins.traceability(scans, {"trivy-fs": "security/trivy-fs.json", "trivy-image": "security/trivy-image.json"})
    return joins.trace_findings(b.findings(spark, sf), written).select("ord", "scan_id", "trace_key", "artifact")


@query(
    "suppress_findings",
    "J9",
    f"""with {b.FINDINGS_SQL}
    select scan_id, id, severity from leveled where id not in (select 'CVE-' || l_orderkey from lineitem where l_returnflag = 'R' and l_linestatus = 'F')""",
)
def suppress(spark, sf):
    """Accepted risks are the findings with a returned, closed line; other lines carry no reason."""
    lines = b.table(spark, sf, "lineitem")
    reason = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "accepted by review").otherwise(" ")
    accepted = lines.select(F.concat(F.lit("CVE-"), F.col("l_orderkey").cast("string")).alias("id"), reason.alias("reason"))
    kept = joins.suppress(b.findings(spark, sf), accepted)
    return kept.select("scan_id", "id", normalize_severity("severity_raw").alias("severity"))


@query(
    "top_findings",
    "W1",
    f"""with {b.FINDINGS_SQL}, r as (
      select scan_id, id, severity, row_number() over (partition by scan_id order by case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end, ord) as rank,
        greatest(count(*) over (partition by scan_id) - 50, 0) as more from leveled)
    select * from r where rank <= 50""",
)
def top(spark, sf):
    rows = b.findings(spark, sf).withColumn("severity", normalize_severity("severity_raw"))
    return ranking.top_findings(rows, n=50).select(
        "scan_id", "id", "severity", F.col("rank").cast("bigint").alias("rank"), F.col("more").cast("bigint").alias("more")
    )


def merged(spark, sf):
    """Issues of tests, coverage, vulnerabilities, secrets and Dockerfile lint, keyed by scan."""
    f = b.findings(spark, sf).withColumn("severity_raw", F.upper("severity_raw"))
    cov = tc.read_cobertura(ingest.cobertura_files(spark, sf)).withColumn("ord", F.ascii("file"))
    failures = tc.failed_cases(tc.read_junit(b.junit_files(spark, sf)))
    part = F.regexp_extract("file", r"(\d+)", 1).cast("bigint")
    failures = failures.withColumn("ord", part * b.SUITE_SPAN + F.col("case_no"))
    blockers = gates.condition_blockers(quality.gate_conditions(quality.read_quality_gate(ingest.gate_files(spark, sf))))
    blockers = blockers.withColumn("pos", F.regexp_extract("file", r"(\d+)", 1).cast("bigint"))
    items = lint.hadolint_items(ingest.hadolint_files(spark, sf)).withColumn("ord", F.regexp_extract("code", r"(\d+)", 1).cast("bigint"))
    return ranking.merge_issues(
        [
            ranking.test_issues(failures),
            ranking.coverage_issues(cov, 50.0),
            ranking.quality_condition_issues(blockers),
            ranking.vulnerability_issues(f),
            ranking.secret_issues(f),
            ranking.lint_issues(items.withColumn("file", F.lit("hadolint.json"))),
        ]
    )


MERGED_SQL = f"""{b.FINDINGS_SQL}, {b.COVERAGE_SQL}, {ingest.GATE_FILES_SQL},
rates as (select *, {ingest.RATE_SQL} as line_pct from counts),
issues as (
  select scan_id, 0 as section, (row_number() over (partition by scan_id, part order by doc_id)) + 1000000 * part as ord, 'Unit Test' as source, 'BLOCKER' as severity,
    'FAILED: ' || source || '.d' || doc_id as title, 'low quality' as detail from labelled where quality = 0
  union all select scan_id, 1, ascii(file), 'Coverage', 'HIGH', 'Coverage below threshold: ' || format('{{:.1f}}', line_pct) || '% < 50.0%',
    'Line coverage ' || covered || '/' || total from rates where line_pct < 50
  union all select scan_id, 2, cast(regexp_extract(file, '\\d+') as bigint), 'SonarQube', 'BLOCKER', 'Quality Gate FAILED: toxic', 'Actual: ' || toxic || ' (threshold: 0)' from gate_status where toxic > 0 and n % 2 = 1
  union all select scan_id, 3, ord, 'Trivy (' || file || ')', severity, id || ': ' || package || case severity when 'CRITICAL' then ' ' || installed else '' end, substr(title, 1, 200)
    from leveled where kind = 'vuln' and severity in ('CRITICAL', 'HIGH')
  union all select scan_id, 4, ord, 'Secret Detection', 'CRITICAL', 'Secret: ' || id || ': ' || package, 'File: ' || target || ', Line: ' || line from findings where kind = 'secret'
  union all select scan_id, 5, ord, 'Hadolint (hadolint.json)', case severity_raw when 'CRITICAL' then 'HIGH' else 'MEDIUM' end, id, title from findings where severity_raw in ('CRITICAL', 'High'))
"""


@query("merge_issues", "W3", f"with {MERGED_SQL} select scan_id, section::bigint as section, source, severity, title, detail from issues")
def merge(spark, sf):
    return merged(spark, sf).select("scan_id", F.col("section").cast("bigint").alias("section"), "source", "severity", "title", "detail")


@query(
    "top_issues",
    "W2",
    f"""with {MERGED_SQL} select scan_id, row_number() over (partition by scan_id order by section, ord) as number, severity, title from issues
    qualify row_number() over (partition by scan_id order by section, ord) <= 50""",
)
def top_issues(spark, sf):
    rows = ranking.top_issues(merged(spark, sf), 50)
    return rows.select("scan_id", F.col("number").cast("bigint").alias("number"), "severity", "title")


@query(
    "findings_union",
    "D1",
    f"""with {b.FINDINGS_SQL} select scan_id, kind, case kind when 'secret' then severity_high else severity end as severity, count(*) as n from leveled group by all""",
)
def union(spark, sf):
    """Three kinds of findings from one parse of the report files, as one table."""
    rows = scanners.all_findings(scanners.read_vuln_reports(b.vuln_reports(spark, sf)))
    return rows.groupBy("scan_id", "kind", "severity").agg(F.count("*").alias("n"))


# --- Sinks: documents are written, read back and compared with direct counts --------------------


@query(
    "write_scan_summary",
    "K1 S25",
    f"""with {SUMMARY_SQL}
    select scan_id, coalesce(critical, 0) as critical, coalesce(high, 0) as high, coalesce(secrets, 0) as secrets, sbom_component_count,
      cast(gate_passed as varchar) as gate_passed, coalesce(types, '') as types from summary""",
)
def write_summary(spark, sf):
    rows = summary_rows(spark, sf).withColumn("gate_status", F.when(F.col("gate_passed"), "PASS").otherwise("FAIL"))
    rows = rows.withColumn("scan_type", F.lit("full")).withColumn("quality_gate", F.lit(None).cast("string"))
    root = shared_dir(spark, "summary")
    sinks.write_documents(sinks.scan_summary_json(rows).select("content"), root, "scan-summary")
    back = spark.read.text(f"{root}/scan-summary").select(
        F.get_json_object("value", "$.scan_id").alias("scan_id"), F.col("value").alias("content")
    )
    out = textual.read_scan_summary(back)
    return out.select(
        "scan_id", "critical", "high", F.col("secrets_found").alias("secrets"), "sbom_component_count",
        F.col("gate_passed").cast("string").alias("gate_passed"), F.coalesce(show_types(), F.lit("")).alias("types"),
    )


@query(
    "write_comprehensive_summary",
    "K1 A1",
    f"""with {b.FINDINGS_SQL}, c as (
      select scan_id, count(*) filter (kind = 'vuln' and severity_raw = 'CRITICAL') as cv, count(*) filter (kind = 'misconfig' and severity_raw = 'CRITICAL') as cm,
        count(*) filter (kind = 'vuln' and severity_raw = 'HIGH') as hv, count(*) filter (kind = 'misconfig' and severity_raw = 'HIGH') as hm, count(*) filter (kind = 'secret') as secrets from findings group by scan_id)
    select scan_id, cv + cm as critical, hv + hm as high, 0::bigint as medium, secrets, parts as sbom_component_count,
      case when cv > 0 or secrets > 0 or hv > 10 or coalesce(failed, 0) > 0 then 'false' else 'true' end as gate_passed
    from c left join (select 'scan-' || l_suppkey as scan_id, count(*) as parts, count(*) filter (l_linestatus = 'F') as failed from lineitem group by 1) using (scan_id)""",
)
def write_comprehensive_summary(spark, sf):
    parts = {
        "tests": totals.test_totals_report(counting.suites(spark, sf)).select("scan_id", "test_failed"),
        "sbom": b.coverage_counts(spark, sf).groupBy("scan_id").agg(F.sum("total").alias("sbom_component_count")),
    }
    counts = joins.scan_summary(totals.severity_totals(b.findings(spark, sf), policy="comprehensive"), parts)
    rows = counts.withColumns({"blockers": F.lit(0).cast("bigint"), "quality_gate": F.lit(None).cast("string")})
    rows = rows.withColumn("overall_status", gates.comprehensive())
    root = shared_dir(spark, "comprehensive")
    docs = sinks.scan_summary_json(sinks.comprehensive_summary(rows))
    sinks.write_documents(docs.select("content"), root, "scan-summary")
    back = spark.read.text(f"{root}/scan-summary").select(
        F.get_json_object("value", "$.scan_id").alias("scan_id"), F.col("value").alias("content")
    )
    return textual.read_scan_summary(back).select(
        "scan_id", "critical", "high", "medium", F.col("secrets_found").alias("secrets"), "sbom_component_count",
        F.col("gate_passed").cast("string").alias("gate_passed"),
    )


def unified_rows(spark, sf):
    f = b.findings(spark, sf)
    by_tool = totals.severity_totals(f, ("scan_id", "tool"), "unified")
    total = by_tool.groupBy("scan_id").agg(*[F.sum(n).alias(n) for n in COUNTS])
    counters = F.create_map(*[x for n in COUNTS for x in (F.lit(n.upper()), F.col(n))])
    tools = by_tool.groupBy("scan_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", F.to_json(counters))))).alias("by_tool_text")
    )
    parts = {
        "totals": total, "tools": tools,
        "tests": totals.test_totals_report(counting.suites(spark, sf)).drop("any_error"),
        "coverage": totals.coverage_overall(counting.adapter_coverage(spark, sf)),
    }
    rows = joins.scan_summary(counting.scans_with_modes(spark, sf), parts)
    strict = F.col("scan_id").rlike("[159]$")
    rows = rows.withColumn("strict", strict).withColumn("reasons", gates.unified_reasons(threshold=50.0))
    status = gates.unified_status(F.col("reasons"), F.lit(0), F.col("strict"))
    return rows.withColumn("status", status)


@query(
    "write_unified_report",
    "K2 S25",
    f"""with {counting.FACTS_SQL}, u as (select scan_id, {counting.sql_counts("true", "case when kind = 'secret' then severity_high else severity end")} from leveled group by scan_id)
    , present as (select scan_id, string_agg(distinct adapter, ',' order by adapter) as adapters, string_agg(distinct adapter, ',' order by adapter) filter (scan_id like '%5' and adapter = 'R') as missing from counts group by 1),
    tools as (select scan_id, tool, {counting.sql_counts("true", "case when kind = 'secret' then severity_high else severity end")} from leveled group by 1, 2),
    listed as (select scan_id, string_agg(tool || ':' || critical || '/' || high || '/' || medium || '/' || low || '/' || unknown, ',' order by tool) as tools,
      string_agg('security:' || tool || '=' || scan_id || '/security/' || tool || '.json', ',' order by tool) as traced from tools group by 1)
    select 'scan-' || c_custkey as scan_id, coalesce(u.critical, 0) as critical, coalesce(u.high, 0) as high,
      cast(not (coalesce(u.critical, 0) > 0 or coalesce(f.test_failed, 0) > 0 or coalesce(f.coverage_pct < 50, false)) as varchar) as gate_passed,
      case c_mktsegment when 'BUILDING' then 'code-only' when 'HOUSEHOLD' then 'image-only' when 'MACHINERY' then 'full' else 'k8s-manifests' end as mode,
      coalesce(adapters, '') as adapters, coalesce(missing, '') as missing, coalesce(tools, '') as tools, coalesce(traced, '') as traced, f.test_failed::bigint as test_failed, f.coverage_pct
    from customer left join u on u.scan_id = 'scan-' || c_custkey left join facts f on f.scan_id = 'scan-' || c_custkey
    left join present on present.scan_id = 'scan-' || c_custkey left join listed on listed.scan_id = 'scan-' || c_custkey""",
)
def write_unified(spark, sf):
    """All fields of the report are real and compared: modes, adapters, what lacks coverage, counters by tool, artifacts of tools."""
    rows = unified_rows(spark, sf)
    tools = F.transform_values("by_tool_text", lambda _, v: F.from_json(v, "map<string,bigint>"))
    found = b.coverage_counts(spark, sf).select("scan_id", "adapter")
    covered = counting.adapter_coverage(spark, sf).select("scan_id", "adapter")
    parts = {
        "adapters": found.groupBy("scan_id").agg(F.sort_array(F.collect_set("adapter")).alias("adapters")),
        "missing": totals.coverage_missing(found, covered),
    }
    rows = joins.scan_summary(rows.withColumn("by_tool", tools), parts)
    artifact = lambda tool: F.struct(F.concat(F.lit("security:"), tool).alias("key"), F.concat("scan_id", F.lit("/security/"), tool, F.lit(".json")).alias("value"))
    rows = rows.withColumn("traceability", F.map_from_entries(F.transform(F.map_keys("by_tool"), artifact)))
    root = shared_dir(spark, "unified")
    sinks.write_documents(sinks.unified_report_json(rows).select("content"), root, "final-report")
    back = spark.read.text(f"{root}/final-report").select(
        F.get_json_object("value", "$.scan_id").alias("scan_id"), F.col("value").alias("content"),
        F.from_json("value", "mode string, adapters array<string>, traceability map<string,string>, summary struct<tests:struct<failed:bigint>,coverage:struct<overall_percent:double,missing:array<string>>>").alias("d"),
    )
    listed = lambda names: F.coalesce(F.array_join(F.sort_array(names), ","), F.lit(""))
    tool_text = F.transform(
        F.sort_array(F.map_keys("findings_by_type")),
        lambda t: F.concat(t, F.lit(":"), F.concat_ws("/", *[F.try_element_at(F.try_element_at("findings_by_type", t), F.lit(n.upper())).cast("string") for n in COUNTS])),
    )
    own = back.select(
        "scan_id", "d.mode", listed(F.col("d.adapters")).alias("adapters"), listed(F.col("d.summary.coverage.missing")).alias("missing"),
        listed(F.transform(F.map_entries("d.traceability"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("traced"),
        F.col("d.summary.tests.failed").alias("test_failed"), F.col("d.summary.coverage.overall_percent").alias("coverage_pct"),
    )
    read = textual.read_unified_report(back).select(
        "scan_id", "critical", "high", F.col("gate_passed").cast("string").alias("gate_passed"), F.coalesce(F.array_join(tool_text, ","), F.lit("")).alias("tools")
    )
    return read.join(own, "scan_id")


@query(
    "write_comprehensive",
    "K3",
    f"""with {MERGED_SQL}, i as (select scan_id, count(*) as critical_issues_count, count(*) filter (section = 0 or section = 2) as blockers, least(count(*), 50) as top from issues group by scan_id),
    v as (select scan_id, count(*) filter (kind = 'vuln' and severity_raw = 'CRITICAL') as critical, count(*) filter (kind = 'vuln' and severity_raw = 'HIGH') as high, count(*) filter (kind = 'secret') as secrets from findings group by 1),
    t as (select scan_id, sum(covered)::bigint as test_failed from counts group by 1),
    worst as (select scan_id, arg_min(title, (section, ord)) as first_title from issues group by 1)
    select scan_id, critical_issues_count, top, first_title, coalesce(critical, 0) as critical, coalesce(high, 0) as high, coalesce(secrets, 0) as secrets, coalesce(test_failed, 0) as test_failed,
      (case when test_failed is null then 0 else 1 end + case when critical is null then 0 else 2 end)::bigint as reports,
      case when blockers > 0 or coalesce(critical, 0) > 0 or coalesce(secrets, 0) > 0 then 'FAIL' when coalesce(high, 0) > 10 or coalesce(test_failed, 0) > 0 then 'WARNING' else 'PASS' end as overall_status
    from i join worst using (scan_id) left join v using (scan_id) left join t using (scan_id)""",
)
def write_comprehensive(spark, sf):
    """Counters, section states and issues of a scan come from its reports; the issues are merged once."""
    issues = staged(merged(spark, sf), "issues")
    counts = issues.groupBy("scan_id").agg(
        F.count("*").alias("critical_issues_count"), F.count_if(F.col("severity") == "BLOCKER").alias("blockers")
    )
    # At most 50 issues of a scan reach this list.
    leading = ranking.top_issues(issues, 50).groupBy("scan_id").agg(
        F.sort_array(F.collect_list(F.struct("number", "source", "severity", "title", "detail"))).alias("top_issues")
    )
    parts = {
        "leading": leading,
        "totals": totals.severity_totals(b.findings(spark, sf), policy="comprehensive").select("scan_id", "critical", "high", "secrets"),
        "tests": totals.test_totals_report(counting.suites(spark, sf)),
    }
    rows = joins.scan_summary(counts, parts)
    none = lambda kind: F.lit(None).cast(kind)
    facts = rows.withColumns({"coverage_pct": none("double"), "quality_gate": none("string"), "sbom_components": none("bigint"), "lint_issues": none("bigint")})
    states = totals.report_sections(facts).groupBy("scan_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "status")))).alias("sections"))
    rows = rows.join(states, "scan_id").fillna(0, ["critical", "high", "secrets", "test_failed"]).withColumn("overall_status", gates.comprehensive())
    root = shared_dir(spark, "comprehensive")
    sinks.write_documents(sinks.comprehensive_json(rows).select(F.concat_ws("\t", "scan_id", "content")), root, "comprehensive-report")
    back = spark.read.text(f"{root}/comprehensive-report")
    doc = F.from_json(
        F.substring_index("value", "\t", -1),
        "overall_status string, critical_issues_count bigint, summary struct<critical:bigint,high:bigint,secrets:bigint,test_failed:bigint>, sections map<string,string>, top_issues array<struct<number:int,title:string>>",
    )
    present = lambda name, value: F.when(F.try_element_at("d.sections", F.lit(name)) != "SKIPPED", value).otherwise(0)
    return back.select(F.substring_index("value", "\t", 1).alias("scan_id"), doc.alias("d")).select(
        "scan_id", "d.critical_issues_count", F.size("d.top_issues").cast("bigint").alias("top"), F.col("d.top_issues")[0]["title"].alias("first_title"), "d.summary.*",
        (present("unit_tests", 1) + present("trivy", 2)).cast("bigint").alias("reports"), "d.overall_status",
    )


@query(
    "write_gate_results",
    "K4 S24",
    f"""with {counting.CHECKS_SQL} select scan_id, critical, secrets, misconfigs, case when critical > 0 or secrets > 0 then 'FAIL' else 'PASS' end as gate_status from checks""",
)
def write_gate(spark, sf):
    counts = totals.severity_totals(b.findings(spark, sf), policy="gate").withColumn(
        "misconfigs", F.col("misconfig_critical") + F.col("misconfig_high")
    ).withColumn("gate_status", gates.critical_or_secret())
    root = shared_dir(spark, "gate")
    text = sinks.gate_results_text(counts)
    sinks.write_documents(text.select(F.concat(F.lit("SCAN_ID="), "scan_id", F.lit("|"), F.replace("content", F.lit("\n"), F.lit("|")))), root, "gate-results")
    back = spark.read.text(f"{root}/gate-results").withColumn("e", textual.key_value_entries(F.replace("value", F.lit("|"), F.lit("\n"))))

    def number(key):
        return textual.last_value(F.col("e"), key).cast("bigint")

    return back.select(
        textual.last_value(F.col("e"), "SCAN_ID").alias("scan_id"), number("CRITICAL_VULNS").alias("critical"),
        number("SECRETS").alias("secrets"), number("MISCONFIGS").alias("misconfigs"),
        textual.last_value(F.col("e"), "GATE_STATUS").alias("gate_status"),
    )


@query(
    "export_visible_artifacts",
    "K5 P5",
    f"with {b.FILES_SQL} select project, count(*) as files, cast(sum(length) as bigint) as bytes from files where name <> 'console-log.txt' group by project",
)
def export_visible(spark, sf):
    rows = b.files(spark, sf).select("project", F.col("path").alias("rel_path"), "length", "content")
    root = shared_dir(spark, "export")
    sinks.visible_artifacts(rows).write.mode("overwrite").parquet(f"{root}/artifacts")
    return spark.read.parquet(f"{root}/artifacts").groupBy("project").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query(
    "write_finding_facts",
    "K6",
    f"""with {b.FINDINGS_SQL} select strftime(day, '%Y-%m-%d') as day, kind, count(*) as n, count(distinct scan_id) as scans from findings group by all""",
)
def write_facts(spark, sf):
    root = shared_dir(spark, "facts")
    facts = b.findings(spark, sf)
    sinks.write_facts(facts, f"{root}/findings", tasks=spark.sparkContext.defaultParallelism)
    back = spark.read.schema(facts.schema).parquet(f"{root}/findings")
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "kind").agg(
        F.count("*").alias("n"), F.countDistinct("scan_id").alias("scans")
    )


def tool_reports(spark, sf):
    """Findings of two scanners: the second one names those of the first kind by advisory, not by CVE."""
    place = F.floor(F.col("ord") / 8).cast("bigint").cast("string")
    own = b.findings(spark, sf).select("scan_id", "target", "package", F.lit("1.0").alias("installed"), F.concat(F.lit("CVE-"), place).alias("id"), "severity_raw", "tool", "kind", place.alias("place"))
    second = own.where("kind = 'vuln'").withColumns({"id": F.concat(F.lit("GHSA-"), F.col("place")), "tool": F.lit("grype"), "severity_raw": F.lit("MEDIUM")})
    return own.unionByName(second)


def advisory_aliases(spark, sf):
    """CVE and advisory of a number are the same; every second pair of numbers is tied by one more name."""
    numbers = b.findings(spark, sf).select(F.floor(F.col("ord") / 8).cast("bigint").alias("k")).distinct()
    name = lambda start, n: F.concat(F.lit(start), n.cast("string"))
    k = F.col("k")
    first = numbers.select(name("CVE-", k).alias("id"), name("GHSA-", k).alias("alias"))
    tied = numbers.where(F.floor(k / 2) % 2 == 0).select(name("PYSEC-", F.floor(k / 2)).alias("id"), name("GHSA-", k).alias("alias"))
    return first.unionByName(tied)


@query(
    "dedupe_findings",
    "D5",
    f"""with {b.FINDINGS_SQL}, names as (select distinct ord // 8 as k from findings),
    identity as (select k, case when (k // 2) % 2 = 0 then min('CVE-' || k) over (partition by k // 2) else 'CVE-' || k end as identity from names),
    reports as (
      select scan_id, target, package, ord // 8 as k, case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end as rank, tool from leveled
      union all select scan_id, target, package, ord // 8, 2, 'grype' from leveled where kind = 'vuln')
    select scan_id, target, package, identity, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'][min(rank) + 1] as severity, string_agg(distinct tool, ',' order by tool) as tools, count(*) as reports
    from reports join identity using (k) group by 1, 2, 3, 4""",
)
def dedupe(spark, sf):
    rows = dedupe_findings(tool_reports(spark, sf), advisory_aliases(spark, sf))
    return rows.select("scan_id", "target", "package", "identity", "severity", F.array_join("tools", ",").alias("tools"), "reports")


@query(
    "supported_adapters",
    "D4",
    f"""with {b.FILES_SQL}, a as (select distinct project, unnest(case name when 'requirements.txt' then ['python'] when 'pom.xml' then ['java'] when 'go.mod' then ['go'] when 'index.html' then ['html-static'] else [] end) as adapter from files)
    select project, string_agg(adapter, ',' order by case adapter when 'python' then 1 when 'java' then 2 else 3 end) as adapters from a where adapter <> 'go' group by project""",
)
def supported(spark, sf):
    name = F.col("name")
    adapter = F.when(name == "requirements.txt", "python").when(name == "pom.xml", "java").when(name == "go.mod", "go").when(name == "index.html", "html-static")
    found = b.files(spark, sf).groupBy("project").agg(F.collect_set(adapter).alias("found"))
    rows = found.select("project", F.array_join(inventory.supported_adapters(F.col("found")), ",").alias("adapters"))
    return rows.where("adapters <> ''")
