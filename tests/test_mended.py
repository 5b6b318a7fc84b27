"""Inputs that the driver's tables do not hold: odd types, long names, nested suites, restarts."""

from pyspark.sql import functions as F

from scanlake import schemas, streaming
from scanlake.operators import inventory, joins, skew, totals
from scanlake.sources import scanners
from scanlake.sources import tests_coverage as tc
from scanlake.sources.artifacts import parse_json


def test_odd_line_numbers_keep_the_findings_of_their_file(spark):
    for value, line in (('"3"', 3), ("3.0", 3), ("3000000000", None), ("7", 7)):
        content = '{"Results":[{"Target":"t","Vulnerabilities":[{"VulnerabilityID":"CVE-1","Severity":"CRITICAL"}],"Secrets":[{"RuleID":"r","Severity":"HIGH","StartLine":%s}]}]}' % value
        files = spark.createDataFrame([("s", "f.json", content)], "scan_id string, file string, content string")
        doc = parse_json(files, schemas.VULN_REPORT)
        assert scanners.all_findings(doc).count() == 2
        assert [r["line"] for r in scanners.flatten_secrets(doc).collect()] == [line]


def test_lcov_readers_agree_on_blanks(spark):
    text = "LF:" + " " * 24 + "10\nLH:5\n"
    whole = tc.read_lcov(spark.createDataFrame([("s", "f", text)], "scan_id string, file string, content string")).first()
    lines = spark.createDataFrame([("s", "f", x) for x in text.splitlines()], "scan_id string, rel_path string, line string")
    assert whole["line_pct"] == tc.lcov_from_lines(lines).first()["line_pct"] == 50.0


def test_names_of_any_length_are_looked_up(spark):
    long = "x" * 90
    folders = spark.createDataFrame([(long,), ("ab",), ("scan-1-full",)], "folder string")
    asked = spark.createDataFrame([(long,), ("ab",), ("scan-1",), ("none",), ("",)], "requested string")
    got = {r["requested"]: (r["folder"], r["how"]) for r in joins.resolve_scan_dir(asked, folders, "legacy").collect()}
    assert got == {long: (long, "exact"), "ab": ("ab", "exact"), "scan-1": ("scan-1-full", "prefix"), "none": ("legacy", "legacy"), "": ("legacy", "legacy")}


def test_rows_without_a_place_stay(spark):
    rows = spark.createDataFrame([("k", 1, 5), ("k", None, 6), (None, 2, 7), ("k", 2, 8)], "key string, at int, v int")
    got = skew.sliced_window(rows, ["key"], ["at"], F.col("at"), 10, sums={"total": F.col("v")}, previous={"before": "v"}).collect()
    assert sorted((r["v"], r["total"], r["before"]) for r in got if r["total"] is not None) == [(5, 5, None), (8, 13, 5)]
    assert sorted(r["v"] for r in got if r["total"] is None) == [6, 7]


def test_suites_in_suites_and_attribute_forms(spark):
    text = '<testsuites tests="1"><testsuite><testsuite><testsuite><testcase classname="c" name="n"><failure message="m"/></testcase></testsuite></testsuite></testsuite></testsuites>'
    files = spark.createDataFrame([("s", "f", text)], "scan_id string, file string, content string")
    assert [r["title"] for r in tc.failed_cases(tc.read_junit(files)).collect()] == ["FAILED: c.n"]
    text = "<report><counter type = 'LINE' missed='1' covered = '3'/></report>"
    files = spark.createDataFrame([("s", "f", text)], "scan_id string, file string, content string")
    assert tc.read_jacoco(files).first()["line_pct"] == 75.0


def test_errors_fail_the_unit_tests_under_either_policy(spark):
    junit = spark.createDataFrame([("s", 3, 0, 1, 0)], "scan_id string, tests long, failures long, errors long, skipped long")
    for variant in ("pytest", "junit"):
        facts = totals.test_totals_report(junit, variant).selectExpr("*", "cast(null as double) as coverage_pct", "cast(null as string) as quality_gate", "cast(null as long) as critical", "cast(null as long) as secrets", "cast(null as long) as sbom_components", "cast(null as long) as lint_issues")
        status = {r["section"]: r["status"] for r in totals.report_sections(facts).collect()}
        assert status["unit_tests"] == "FAIL"


def test_agents_are_counted_and_a_restart_keeps_the_result(spark, tmp_path):
    rows = [("p", "a", "2024-01-01 00:00:00", "create"), ("p", "a", "2024-01-01 00:01:00", "create"), ("p", "b", "2024-01-01 00:02:00", "destroy"), ("q", "c", "2024-01-01 00:00:00", "create"), ("q", "c", "2024-01-01 00:00:00", "destroy")]
    df = spark.createDataFrame(rows, "pool string, agent string, ts string, action string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        got = {r["pool"]: r["active"] for r in streaming.active_agents(stream, str(tmp_path / "out"), 10).collect()}
        assert got == {"p": 1, "q": 0}


def test_a_build_that_ends_late_is_seen(spark, tmp_path):
    schema = "job string, number long, ts timestamp, building boolean, result string"
    for k, (ts, building) in enumerate((("2024-01-01 00:00:00", True), ("2024-01-01 01:30:00", True), ("2024-01-01 00:00:00", False))):
        spark.createDataFrame([("j", k % 2, ts, building, "OK")], "job string, number long, ts string, building boolean, result string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert [r["number"] for r in streaming.await_terminal(stream, str(tmp_path / "out")).collect()] == [0]


def test_modules_are_found_without_the_texts_of_other_files(spark, tmp_path):
    rows = [("p", "web/package.json", '{"vue": 1}'), ("p", "web/a.py", "x"), ("p", "package.json", '{"react": 1}'), ("q", "go.mod", None), ("q", "lib/package.json", None)]
    spark.createDataFrame(rows, "project string, path string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    got = {(r["project"], r["module"]): r["language"] for r in inventory.discover_modules(files).collect()}
    assert got == {("p", "root"): "react", ("p", "web"): "vue", ("q", "root"): "go", ("q", "lib"): "nodejs"}
    adapters = {(r["project"], r["adapter"]): r["signals"] for r in inventory.detect_adapters(files).collect()}
    assert adapters == {("p", "node-react"): ["package.json", "react-dependency"]}
    for found in (inventory.discover_modules(files), inventory.detect_adapters(files), inventory.detect_language(files, "ci")):
        plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        reads = ["content" in line for line in plan.splitlines() if line.startswith("ReadSchema")]
        assert sorted(reads) == [False, True], plan
        assert "package.json" in plan[plan.index("Filter"):]
