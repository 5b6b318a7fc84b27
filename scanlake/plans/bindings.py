"""The driver's tables as reports and facts (see FIXTURES.md, bindings B1-B9).

Report files are packed per scan and key range: a range holds a fixed number of key values, so no
document grows with its scan, and a scan with most of the rows has many files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SPAN = 8192


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- B1: findings from orders ------------------------------------------------------------------

# Report types, their file names and the tools that write them.
REPORT_BY_QUARTER = ("sast", "sca", "image", "k8s")
FILE_BY_REPORT = {
    "sast": "trivy-fs-scan.json", "sca": "trivy-sca.json", "image": "trivy-image-scan.json",
    "k8s": "trivy-k8s-scan.json",
}
TOOL_BY_REPORT = {"sast": "trivy-fs", "sca": "trivy-fs", "image": "trivy-image", "k8s": "trivy-config"}


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """One finding per order: scan = customer, kind = order status, severity = priority (HIGH in mixed case)."""
    return table(spark, sf, "orders").selectExpr(
        "concat('scan-', o_custkey) as scan_id",
        "o_orderkey as ord",
        "case o_orderstatus when 'F' then 'vuln' when 'O' then 'misconfig' else 'secret' end as kind",
        f"elt(quarter(o_orderdate), {_quoted(REPORT_BY_QUARTER)}) as report",
        "concat('CVE-', o_orderkey) as id",
        "concat('pkg-', year(o_orderdate)) as package",
        "cast(floor(o_totalprice) as string) as installed",
        "case when o_orderstatus = 'F' then date_format(o_orderdate, 'yyyy-MM-dd') end as fixed",
        "repeat(concat(o_orderpriority, ' '), day(o_orderdate)) as title",
        "case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'High'"
        " when '3-MEDIUM' then 'MEDIUM' when '5-LOW' then 'LOW' end as severity_raw",
        "concat('target-', quarter(o_orderdate)) as target",
        "day(o_orderdate) as line",
        "cast(o_orderdate as date) as day",
        f"elt(quarter(o_orderdate), {_quoted(FILE_BY_REPORT.values())}) as file",
        f"elt(quarter(o_orderdate), {_quoted(TOOL_BY_REPORT.values())}) as tool",
    )


def _quoted(names) -> str:
    return ", ".join(f"'{name}'" for name in names)


FINDINGS_SQL = """
findings as (
  select 'scan-' || o_custkey as scan_id, o_orderkey as ord,
    case o_orderstatus when 'F' then 'vuln' when 'O' then 'misconfig' else 'secret' end as kind,
    case quarter(o_orderdate) when 1 then 'sast' when 2 then 'sca' when 3 then 'image' else 'k8s' end as report,
    case quarter(o_orderdate) when 1 then 'trivy-fs-scan.json' when 2 then 'trivy-sca.json'
      when 3 then 'trivy-image-scan.json' else 'trivy-k8s-scan.json' end as file,
    case quarter(o_orderdate) when 1 then 'trivy-fs' when 2 then 'trivy-fs' when 3 then 'trivy-image'
      else 'trivy-config' end as tool,
    'CVE-' || o_orderkey as id, 'pkg-' || year(o_orderdate) as package,
    cast(cast(floor(o_totalprice) as bigint) as varchar) as installed,
    case when o_orderstatus = 'F' then strftime(o_orderdate, '%Y-%m-%d') end as fixed,
    repeat(o_orderpriority || ' ', day(o_orderdate)) as title,
    case o_orderpriority when '1-URGENT' then 'CRITICAL' when '2-HIGH' then 'High' when '3-MEDIUM' then 'MEDIUM'
      when '5-LOW' then 'LOW' end as severity_raw,
    'target-' || quarter(o_orderdate) as target, day(o_orderdate) as line,
    cast(o_orderdate as date) as day
  from orders),
leveled as (
  select *, case when upper(coalesce(severity_raw, '')) in ('CRITICAL','HIGH','MEDIUM','LOW')
    then upper(severity_raw) else 'UNKNOWN' end as severity,
    case when upper(coalesce(severity_raw, 'HIGH')) in ('CRITICAL','HIGH','MEDIUM','LOW')
    then upper(coalesce(severity_raw, 'HIGH')) else 'UNKNOWN' end as severity_high
  from findings)
"""


def _pack(rows: DataFrame, keys: list[str], key: Column, items: dict[str, Column], span: int = FILE_SPAN, collect: Callable[[Column], Column] = F.collect_list) -> DataFrame:
    """Lists per (keys, key range), sorted by the first field of their structs."""
    return rows.groupBy(*keys, F.floor(key / span).cast("bigint").alias("part")).agg(
        *[F.sort_array(collect(item)).alias(name) for name, item in items.items()]
    )


def vuln_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Scanner report files (scan_id, file, content). Results of the three kinds, the absent lists null."""
    item = F.struct("ord", "kind", "id", "package", "installed", "fixed", "severity_raw", "title", "line")
    packed = _pack(findings(spark, sf), ["scan_id", "file", "target"], F.col("ord"), {"items": item})

    def of_kind(kind: str, **fields: str) -> Column:
        """The entries of one kind in the scanner's own field names; null where there are none."""
        own = F.filter("items", lambda x: x["kind"] == kind)
        shaped = F.transform(own, lambda x: F.struct(*[x[source].alias(name) for name, source in fields.items()]))
        return F.when(F.exists("items", lambda x: x["kind"] == kind), shaped)

    result = F.struct(
        F.col("target").alias("Target"),
        of_kind(
            "vuln", VulnerabilityID="id", PkgName="package", InstalledVersion="installed", FixedVersion="fixed",
            Severity="severity_raw", Title="title",
        ).alias("Vulnerabilities"),
        of_kind(
            "misconfig", ID="id", Type="package", Severity="severity_raw", Title="title", Resolution="title"
        ).alias("Misconfigurations"),
        of_kind(
            "secret", RuleID="id", Category="package", Severity="severity_raw", Title="title", StartLine="line"
        ).alias("Secrets"),
    )
    return packed.select(
        "scan_id",
        F.concat(F.regexp_replace("file", r"\.json$", ""), F.lit("-"), F.col("part").cast("string"), F.lit(".json")).alias("file"),
        F.to_json(F.struct(F.array(result).alias("Results")), {"ignoreNullFields": "false"}).alias("content"),
    )


def lint_files(
    spark: SparkSession, sf: str, item: Column, wrap: Column | None = None, where: str = "true",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """JSON list files per scan from the finding rows: ``item`` is one entry, ``wrap`` the document around ``items``.

    ``extra`` columns split the files further and are kept."""
    extra = extra or {}
    rows = findings(spark, sf).where(where).withColumn("item", F.struct("ord", item.alias("x"))).withColumns(extra)
    packed = _pack(rows, ["scan_id", *extra], F.col("ord"), {"items": F.col("item")})
    packed = packed.withColumn("items", F.transform("items", lambda i: i["x"]))
    doc = wrap if wrap is not None else F.col("items")
    return packed.select(
        "scan_id",
        *extra,
        F.concat(F.lit("report-"), F.col("part").cast("string"), F.lit(".json")).alias("file"),
        F.col("part"),
        F.to_json(doc, {"ignoreNullFields": "false"}).alias("content"),
    )


# --- B2: components from lineitem and part ------------------------------------------------------


def components(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "concat('bom-', l_orderkey) as scan_id", "l_partkey as ord", "p_type as type", "p_name as name", "p_brand as version"
    )


COMPONENTS_SQL = """
components as (
  select 'bom-' || l_orderkey as scan_id, l_partkey as ord, p_type as type, p_name as name, p_brand as version,
    l_partkey // 16384 as part
  from lineitem join part on l_partkey = p_partkey)
"""
BOM_SPAN = 16384
#: Component rows that an aggregating task is to hold at most, about: it needs some 0.5 KB for each.
TASK_ROWS = 500_000


def component_partitions(spark: SparkSession, sf: str) -> int | None:
    """Tasks for the component rows, where the session's own number would hold more than ``TASK_ROWS`` in each."""
    wanted = -(-table(spark, sf, "lineitem").count() // TASK_ROWS)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _bom_files(rows: DataFrame, item: Column, once: bool = False) -> DataFrame:
    """``once``: one item per ``ord``, settled inside the file, as all rows of an ``ord`` are in the same one."""
    packed = _pack(rows.withColumn("item", F.struct("ord", item.alias("x"))), ["scan_id"], F.col("ord"),
                   {"items": F.col("item")}, BOM_SPAN, F.collect_set if once else F.collect_list)
    if once:
        first = F.filter("items", lambda x, n: (n == 0) | ~x["ord"].eqNullSafe(F.get("items", n - 1)["ord"]))
        packed = packed.withColumn("items", first)
    return packed.withColumn("items", F.transform("items", lambda i: i["x"])).withColumn(
        "file", F.concat(F.lit("sbom-"), F.col("part").cast("string"), F.lit(".json"))
    )


def sbom_files(spark: SparkSession, sf: str) -> DataFrame:
    c = components(spark, sf)
    item = F.struct(
        "type", "name", "version",
        F.concat(F.lit("pkg:generic/"), "name", F.lit("@"), "version").alias("purl"),
    )
    doc = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"), F.col("items").alias("components")
    )
    return _bom_files(c, item).select("scan_id", "file", F.to_json(doc).alias("content"))


# --- B3: builds from events ---------------------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(table(spark, sf, "events"))


def event_rows(raw: DataFrame) -> DataFrame:
    """Builds of three jobs: an error is a FAILURE, a view UNSTABLE, a click still runs."""
    return raw.selectExpr(
        "event_id as number",
        "concat('job-', user_id % 3) as job",
        "cast(ts as timestamp) as ts",
        "user_id",
        "event_type",
        "case event_type when 'error' then 'FAILURE' when 'view' then 'UNSTABLE' when 'click' then null else 'SUCCESS' end as result",
        "event_type = 'click' as building",
        "cast(value * 1000 as bigint) as duration_ms",
        "get_json_object(props, '$.k') as k",
        "value",
    )


EVENTS_SQL = """
builds as (
  select event_id as number, 'job-' || (user_id % 3) as job, ts, user_id, event_type,
    case event_type when 'error' then 'FAILURE' when 'view' then 'UNSTABLE' when 'click' then null else 'SUCCESS' end as result,
    event_type = 'click' as building, cast(trunc(value * 1000) as bigint) as duration_ms,
    json_extract_string(props, '$.k') as k, value
  from events)
"""


def build_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One CI document per event; SCAN_ID is given twice, in two actions, and the second one holds."""
    e = event_rows(table(spark, sf, "events"))

    def param(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    scan = F.concat(F.lit("scan-"), "k")
    doc = F.struct(
        "number", "result", "building",
        F.unix_millis("ts").alias("timestamp"),
        F.col("duration_ms").alias("duration"),
        F.concat(F.lit("job/"), "job", F.lit("/"), F.col("number").cast("string")).alias("url"),
        F.array(
            F.struct(F.array(param("SCAN_ID", F.lit("draft")), param("MODE", F.col("event_type"))).alias("parameters")),
            F.struct(F.lit(None).cast("array<struct<name:string,value:string>>").alias("parameters")),
            F.struct(F.array(param("SCAN_ID", scan)).alias("parameters")),
        ).alias("actions"),
        F.when(
            F.col("event_type") == "purchase",
            F.array(F.struct(F.lit("report.json").alias("fileName"), F.lit("out/report.json").alias("relativePath"))),
        ).otherwise(F.array().cast("array<struct<fileName:string,relativePath:string>>")).alias("artifacts"),
    )
    return e.select("job", F.to_json(doc).alias("content"))


# --- B4: files from documents -------------------------------------------------------------------

FILE_NAMES = (
    "requirements.txt", "pom.xml", "package.json", "go.mod", "Dockerfile", "index.html", "test_main.py", "LICENSE",
    ".env", ".gitignore", "app.ts", "console-log.txt", "Makefile", "main.cpp", "deploy.yml", "routes.py",
)


def files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per document; names rotate, folders follow the language, projects the source."""
    name = f"elt(cast(doc_id % {len(FILE_NAMES)} + 1 as int), {_quoted(FILE_NAMES)})"
    folder = "case lang when 'en' then '' when 'fr' then 'backend/' when 'de' then 'web/tests/' else 'web/node_modules/lib/' end"
    return table(spark, sf, "documents").selectExpr(
        "source as project", f"concat({folder}, {name}) as path", f"{name} as name", "doc_id", "lang", "text as content",
        "cast(octet_length(text) as bigint) as length",
    )


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in FILE_NAMES) + "]"
FILES_SQL = f"""
files as (
  select source as project, doc_id, lang, text as content, strlen(text) as length,
    ({_NAMES_SQL})[doc_id % {len(FILE_NAMES)} + 1] as name,
    case lang when 'en' then '' when 'fr' then 'backend/' when 'de' then 'web/tests/' else 'web/node_modules/lib/' end
      || ({_NAMES_SQL})[doc_id % {len(FILE_NAMES)} + 1] as path
  from documents),
lines as (
  select project, path, doc_id, name, unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) as line,
    unnest(range(1, len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) + 1)) as line_no
  from files)
"""


# --- B6: console chunks from conversations ------------------------------------------------------


def chunk_rows(raw: DataFrame) -> DataFrame:
    """Console chunks. The text is opened by a phase word, often the one of the chunk before, at times by none."""
    return raw.selectExpr(
        "conv_id as build",
        "turn as offset",
        "concat(case when turn % 4 < 2 then 'git clone ' when turn % 4 = 3 then '' when role = 'user' then 'git clone '"
        " when role = 'assistant' then 'pytest ' else 'artifact ' end, text) as text",
    )


CHUNKS_SQL = """
chunks as (
  select conv_id as build, turn as "offset",
    case when turn % 4 < 2 then 'git clone ' when turn % 4 = 3 then '' when role = 'user' then 'git clone '
      when role = 'assistant' then 'pytest ' else 'artifact ' end || text as text
  from conversations)
"""


# --- B7: test reports from labels and documents -------------------------------------------------


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("lang").alias("scan_id"), "doc_id", "source", "quality", "toxic"
    )


LABELLED_SQL = """
labelled as (
  select lang as scan_id, doc_id, source, quality, toxic, doc_id // 256 as part
  from labels join documents using (doc_id))
"""
SUITE_SPAN = 256


def junit_files(spark: SparkSession, sf: str) -> DataFrame:
    """Suites per language and document range; quality 0 is a failure, toxic 1 an error. Every file has a DOCTYPE,
    and odd ranges nest their suite in a ``testsuites`` root that carries the totals."""
    rows = labelled(spark, sf)
    case = F.concat(
        F.lit('<testcase classname="'), "source", F.lit('" name="d'), F.col("doc_id").cast("string"), F.lit('">'),
        F.when(F.col("quality") == 0, '<failure message="low quality"/>').otherwise(""),
        F.lit("</testcase>"),
    )
    packed = rows.groupBy("scan_id", F.floor(F.col("doc_id") / SUITE_SPAN).cast("bigint").alias("part")).agg(
        F.count("*").alias("tests"),
        F.count_if(F.col("quality") == 0).alias("failures"),
        F.count_if(F.col("toxic") == 1).alias("errors"),
        F.sort_array(F.collect_list(F.struct("doc_id", case.alias("xml")))).alias("cases"),
    )
    body = F.array_join(F.transform("cases", lambda c: c["xml"]), "")
    head = F.concat(
        *[x for name in ("tests", "failures", "errors") for x in (F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))],
        F.lit(' skipped="1" time="1.5"'),
    )
    flat = F.concat(F.lit("<testsuite"), head, F.lit(">"), body, F.lit("</testsuite>"))
    nested = F.concat(F.lit("<testsuites"), head, F.lit('><testsuite name="s">'), body, F.lit("</testsuite></testsuites>"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><!DOCTYPE suite SYSTEM "suite.dtd">'), F.when(F.col("part") % 2 == 1, nested).otherwise(flat)
    )
    return packed.select(
        "scan_id", "part", F.concat(F.lit("TEST-"), F.col("part").cast("string"), F.lit(".xml")).alias("file"),
        xml.alias("content"),
    )


# --- B9: coverage from lineitem -----------------------------------------------------------------


def coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier (scan) and return flag (adapter): lines and covered lines."""
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count("*").alias("total"), F.expr("count_if(l_linestatus = 'F')").alias("covered")
    )
    return counts.selectExpr(
        "concat('scan-', l_suppkey) as scan_id", "l_returnflag as adapter", "concat(l_returnflag, '.report') as file", "total", "covered"
    )


COVERAGE_SQL = """
counts as (
  select 'scan-' || l_suppkey as scan_id, l_returnflag as adapter, l_returnflag || '.report' as file,
    count(*) as total, count(*) filter (l_linestatus = 'F') as covered
  from lineitem group by l_suppkey, l_returnflag)
"""


def sql_pct(num: str, den: str) -> str:
    return f"cast(format('{{:.1f}}', ({num}) / ({den}) * 100.0) as double)"


# --- Report folders: every kind of file that a scan's summary reads ------------------------------


def report_folders(spark: SparkSession, sf: str) -> DataFrame:
    """(scan_id, file, content) of all customers' scans.

    The first key range of a report type has the type's own name, further ranges are reports of registry images. By the customer's
    number a scan also has a pipeline summary (1 of 10; one more is cut off), a local report, linter lists, a gate file, one or two
    component inventories (the preferred one broken at times) and a quality gate.
    """
    part = F.regexp_extract("file", r"-(\d+)\.json$", 1)
    base = F.regexp_replace("file", r"-\d+\.json$", "")
    reports = vuln_reports(spark, sf).select(
        "scan_id", F.when(part == "0", F.concat(base, F.lit(".json"))).otherwise(F.concat(F.lit("registry-scan-"), base, F.lit("-"), part, F.lit(".json"))).alias("file"), "content"
    )
    secrets = findings(spark, sf).where(f"kind = 'secret' and ord < {FILE_SPAN}").groupBy("scan_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    secrets = secrets.select("scan_id", F.lit("secret-scan.json").alias("file"), F.to_json(F.struct(F.array(F.struct(F.transform("ids", lambda i: F.struct(i.alias("RuleID"))).alias("Secrets"))).alias("Results"))).alias("content"))
    k = F.col("c_custkey")
    doc = F.struct

    def counters(**numbers) -> Column:
        return doc(*[v.cast("bigint").alias(n) for n, v in numbers.items()])

    summary = F.to_json(doc(
        (k % 20 == 1).alias("gate_passed"), counters(critical=k, high=k + 1).alias("totals"),
        doc(counters(critical=k, high=k + 1).alias("SAST"), counters(found=k).alias("Secret Detection")).alias("findings_by_scan"), F.lit(7).alias("secrets_found"),
    ))
    local = F.to_json(doc(doc(
        doc(F.when(k % 4 == 2, "PASS").otherwise("DEGRADED").alias("status")).alias("gate_verdict"), F.create_map(F.lit("HIGH"), k).alias("severity_totals"),
        F.create_map(F.lit("sonar-scanner"), doc((k % 4 == 2).alias("available"))).alias("tool_status"),
    ).alias("summary"), F.create_map(F.lit("trivy-fs"), F.create_map(F.lit("LOW"), k)).alias("findings_by_tool")))
    inventory = F.to_json(doc(F.transform(F.sequence(F.lit(1), F.col("c_nationkey") + 1), lambda n: doc(n.cast("string").alias("type"))).alias("components")))
    lint = F.to_json(F.transform(F.sequence(F.lit(1), k % 3), lambda n: doc(n.alias("line"))))
    other = {
        "scan-summary.json": F.when(k % 10 == 1, summary).when(k % 10 == 2, F.expr("'{'")),
        "final-report.json": F.when((k % 10).isin(2, 3), local).when(k % 10 == 4, F.expr("'{}'")),
        "shellcheck.json": F.when(k % 4 == 1, F.when(k % 3 == 0, "[]").otherwise(lint)),
        "sbom/trivy-cyclonedx-full.json": F.when(k % 7 == 3, "broken"),
        "sbom-trivy-cyclonedx.json": F.when(k % 7 < 5, inventory),
        "sonarqube/quality-gate.json": F.when(k % 2 == 0, F.to_json(doc(doc(F.lit("ok").alias("status")).alias("projectStatus")))).otherwise('{"status": ""}'),
        "gate-results.txt": F.when(k % 5 == 0, "A=1\nGATE_STATUS = fail").when(k % 5 == 1, "GATE_STATUS=FAIL\nGATE_STATUS=PASS").when(k % 5 == 2, "the check failed").when(k % 5 == 3, "fine"),
        "notes.json": F.lit("{}"),
    }
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("scan-"), k.cast("string")).alias("scan_id"), F.inline(F.array(*[doc(F.lit(name).alias("file"), text.alias("content")) for name, text in other.items()]))
    )
    return reports.unionByName(secrets).unionByName(rows.where("content is not null"))


REPORT_FOLDERS_SQL = f"""
customers as (select c_custkey as k, c_nationkey, 'scan-' || c_custkey as scan_id from customer),
typed as (
  select scan_id, case when ord // {FILE_SPAN} = 0 then report else 'registry:' || replace(file, '.json', '') || '-' || (ord // {FILE_SPAN}) end as report, kind, severity from leveled),
by_type as (
  select scan_id, report, count(*) filter (kind <> 'secret' and severity = 'CRITICAL') as critical, count(*) filter (kind <> 'secret' and severity = 'HIGH') as high,
    count(*) filter (kind <> 'secret' and severity = 'MEDIUM') as medium, count(*) filter (kind <> 'secret' and severity = 'LOW') as low,
    count(*) filter (kind <> 'secret' and severity = 'UNKNOWN') as unknown from typed group by 1, 2
  union all select scan_id, 'shellcheck', 0, 0, 0, k % 3, 0 from customers where k % 4 = 1 and k % 3 > 0),
raw as (
  select scan_id, sum(critical)::bigint as critical, sum(high)::bigint as high, sum(medium)::bigint as medium, sum(low)::bigint as low, sum(unknown)::bigint as unknown,
    string_agg(report || ':' || critical || '/' || high || '/' || medium || '/' || low || '/' || unknown, ',' order by report) as types from by_type group by 1),
found_secrets as (select scan_id, count(*) as secrets from findings where kind = 'secret' and ord < {FILE_SPAN} group by 1),
whole as (
  select c.scan_id, k, case when k % 10 = 1 then 'summary' when k % 10 in (2, 3) then 'unified' else 'raw' end as source, coalesce(critical, 0) as critical, coalesce(high, 0) as high, coalesce(medium, 0) as medium,
    coalesce(low, 0) as low, coalesce(unknown, 0) as unknown, coalesce(types, '') as types, coalesce(secrets, 0) as secrets, case when k % 7 in (0, 1, 2, 4) then c_nationkey + 1 end as components
  from customers c left join raw using (scan_id) left join found_secrets using (scan_id))
"""
