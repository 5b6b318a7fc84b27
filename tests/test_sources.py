"""Edge cases of report files, as small literal tables."""

import json

from scanlake.functions.rows import each
from scanlake.sources import artifacts, components, lint, quality, scanners, tests_coverage as tc, textual


def files(spark, *contents, scan="s"):
    rows = [(f"{scan}{i}", f"f{i}", content) for i, content in enumerate(contents)]
    return spark.createDataFrame(rows, "scan_id string, file string, content string")


def values(df, *columns):
    return [tuple(row) for row in df.select(*columns).collect()]


def report(**lists):
    return json.dumps({"Results": [{"Target": "t", **lists}]})


def test_missing_null_and_empty_lists_give_no_findings(spark):
    df = files(
        spark, report(), report(Vulnerabilities=None), report(Vulnerabilities=[]), '{"Results":null}', "{}", "", "[]", '"text"', "{bad"
    )
    reports = scanners.read_vuln_reports(df)
    assert scanners.flatten_vulnerabilities(reports).count() == 0
    assert scanners.all_findings(reports).count() == 0
    assert scanners.finding_counts(df).count() == 0


def test_unreadable_files_are_marked_and_do_not_stop_the_others(spark):
    good = report(Vulnerabilities=[{"VulnerabilityID": "A", "Severity": "high"}])
    reports = scanners.read_vuln_reports(files(spark, "{bad", good, '{"Results":'))
    assert [r[0] for r in values(reports.orderBy("file"), "well_formed")] == [False, True, False]
    assert values(scanners.flatten_vulnerabilities(reports), "scan_id", "severity", "id") == [("s1", "HIGH", "A")]


def test_severity_defaults(spark):
    item = [{"Severity": None}, {}, {"Severity": "critical"}, {"Severity": "odd"}, {"Severity": ""}]
    reports = scanners.read_vuln_reports(files(spark, report(Vulnerabilities=item, Secrets=item)))
    vulns = [r[0] for r in values(scanners.flatten_vulnerabilities(reports).orderBy("finding_no"), "severity")]
    secrets = [r[0] for r in values(scanners.flatten_secrets(reports).orderBy("finding_no"), "severity")]
    assert vulns == ["UNKNOWN", "UNKNOWN", "CRITICAL", "UNKNOWN", "UNKNOWN"]
    assert secrets == ["HIGH", "HIGH", "CRITICAL", "UNKNOWN", "HIGH"]


def test_single_pass_findings_equal_the_three_kinds(spark):
    item = [{"Severity": "LOW", "Title": "x" * 130, "ID": "i", "RuleID": "r", "VulnerabilityID": "v", "Resolution": "y" * 90}]
    reports = scanners.read_vuln_reports(files(spark, report(Vulnerabilities=item, Misconfigurations=item, Secrets=item)))
    parts = [
        values(f(reports), *scanners.FINDING_COLUMNS)
        for f in (scanners.flatten_vulnerabilities, scanners.flatten_misconfigurations, scanners.flatten_secrets)
    ]
    assert sorted(values(scanners.all_findings(reports), *scanners.FINDING_COLUMNS)) == sorted(sum(parts, []))
    assert parts[0][0][8] == "x" * 117 + "..." and len(parts[1][0][8]) == 120 and len(parts[1][0][7]) == 80


def test_title_falls_back_to_description(spark):
    reports = scanners.read_vuln_reports(files(spark, report(Vulnerabilities=[{"Description": "d"}])))
    assert values(scanners.flatten_vulnerabilities(reports), "title") == [("d",)]


def test_sbom_counts_keep_null_apart_from_zero(spark):
    df = files(spark, '{"components":[{"type":"a"},{}]}', '{"components":null}', "{}", "{bad")
    counts = values(components.sbom_component_count(df).orderBy("file"), "components")
    assert [c[0] for c in counts] == [2, 0, 0, None]
    types = components.read_sbom(df).where("has_component")
    assert sorted(values(types, "type"), key=str) == [(None,), ("a",)] or types.count() == 2


def test_junit_doctype_nested_and_malformed(spark):
    flat = '<?xml version="1.0"?><!DOCTYPE t SYSTEM "x.dtd"><testsuite tests="3" failures="1" errors="0" skipped="1"><testcase classname="c" name="n"><failure message="m"/></testcase></testsuite>'
    nested = '<testsuites><testsuite tests="5"><testcase name="n2"><failure/></testcase></testsuite></testsuites>'
    junit = tc.read_junit(files(spark, flat, nested, "<testsuite tests="))
    assert values(junit.orderBy("file"), "tests", "failures", "skipped") == [(3, 1, 1), (0, 0, 0), (0, 0, 0)]
    assert sorted(values(tc.failed_cases(junit), "title", "detail")) == [("FAILED: .n2", ""), ("FAILED: c.n", "m")]


def test_cobertura_without_rate_or_with_a_bad_one(spark):
    df = files(spark, '<coverage line-rate="0.8555"/>', "<coverage/>", '<coverage line-rate="x"/>', "<coverage")
    assert values(tc.read_cobertura(df).orderBy("file"), "line_pct") == [(85.5,), (None,), (None,), (None,)]


def test_jacoco_modes(spark):
    xml = '<r><counter type="LINE" missed="1" covered="0"/><counter covered="3" type="LINE" missed="1"/></r>'
    df = files(spark, xml, "<r/>", '<r><counter type="LINE" missed="0" covered="0"/></r>')
    got = {mode: [r[0] for r in values(tc.read_jacoco(df, mode).orderBy("file"), "line_pct")] for mode in ("first", "last", "sum")}
    assert got == {"first": [0.0, None, 0.0], "last": [75.0, None, 0.0], "sum": [60.0, 0.0, 0.0]}


def test_lcov_zero_lines_and_bad_counts(spark):
    df = files(spark, "LF:4\nLH:3\nSF:x\nLF:4\nLH:2", "LF:0\nLH:0", "LF:x\nLH:1", "")
    assert values(tc.read_lcov(df).orderBy("file"), "line_pct") == [(62.5,), (None,), (None,), (None,)]


def test_rounding_is_half_even_on_the_binary_value(spark):
    numbers = [0.05, 0.15, 0.25, 0.35, 2.675, 12.25, 99.95, 1 / 3]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    from scanlake.functions.numbers import one_digit

    assert [r[0] for r in df.select(one_digit("x")).collect()] == [round(x, 1) for x in numbers]


def test_go_events_skip_bad_lines_and_packages(spark):
    text = '{"Action":"pass","Test":"a"}\n{bad\n{"Action":"pass"}\n{"Action":"fail","Test":"b"}\n{"Action":"fail","Test":""}\n'
    assert values(tc.read_go_tests(files(spark, text)), "passed", "failed") == [(1, 1)]


def test_quality_gate_shapes(spark):
    df = files(spark, '{"projectStatus":{"status":"ok"}}', '{"status":"Error"}', '{"projectStatus":{"status":""}}', "{}", "{bad", '{"projectStatus":{},"status":"warn"}')
    assert [r[0] for r in values(quality.read_quality_gate(df).orderBy("file"), "status")] == ["OK", "ERROR", None, None, None, "WARN"]


def test_hadolint_lists_of_lists(spark):
    df = files(spark, '[[{"level":"error"}],[{"level":"warning"}]]', '[{"level":"info"}]', "[]", "[[]]", "")
    got = values(lint.read_hadolint(df.selectExpr("'s' as scan_id", "file", "content")), "total", "high", "medium")
    assert got == [(3, 1, 1)]


def test_text_issue_counts(spark):
    df = files(spark, "a\n\nb\n", "a\n \t\nb", "", "\n")
    every = sorted(values(lint.count_text_issues(df), "scan_id", "issues"))
    visible = sorted(values(lint.count_text_issues(df, blank=False), "scan_id", "issues"))
    assert [n for _, n in every] == [3, 3, 0, 1] and [n for _, n in visible] == [2, 2, 0, 0]


def test_key_values_last_one_wins_and_values_hold_signs(spark):
    df = files(spark, "A=1\n B = x=y \nno sign\nA=2\n=v\n")
    got = sorted(values(textual.parse_key_values(df), "key", "value"))
    assert got == [("", "v"), ("A", "2"), ("B", "x=y")]


def test_lock_prefers_packages_and_drops_the_project(spark):
    df = files(
        spark, '{"packages":{"":{"version":"1"},"node_modules/a/node_modules/b":{"version":"2"},"c":{}},"dependencies":{"z":{"version":"9"}}}',
        '{"dependencies":{"z":{"version":"9"}}}', '{"packages":{},"dependencies":{"z":{"version":"9"}}}',
    )
    got = sorted(values(components.lockfile_components(df), "scan_id", "name", "version"))
    assert got == [("s0", "a/b", "2"), ("s0", "c", "unknown"), ("s1", "z", "9")]


def test_gosum_once_per_version(spark):
    df = files(spark, "m v1.0 h1:a\nm v1.0/go.mod h1:b\nm v2.0 h1:c\nbad\n")
    assert sorted(values(components.gosum_components(df), "name", "version")) == [("m", "1.0"), ("m", "2.0")]


def test_catalog_skips_null_tags(spark):
    repos = spark.createDataFrame([('{"repositories":["a","b"]}',)], "content string")
    tags = spark.createDataFrame([("a", '{"tags":["1","2"]}'), ("b", '{"tags":null}')], "repo string, content string")
    got = sorted(values(components.expand_image_catalog(repos, tags, "r"), "image"))
    assert got == [("r/a:1",), ("r/a:2",)]


def test_agent_lines(spark):
    df = spark.createDataFrame([("x\n scan-agent-1  online\nscan-agent-2\nscan-agent-3 OFFLINE\n",)], "content string")
    got = sorted(values(textual.parse_agent_list(df), "name", "online"))
    assert got == [("scan-agent-1", True), ("scan-agent-2", False), ("scan-agent-3", False)]


def test_summary_without_secret_entry_in_types(spark):
    doc = '{"totals":{"critical":2},"findings_by_scan":{"SAST":{"critical":2},"Secret Detection":{"found":1}}}'
    row = textual.read_scan_summary(files(spark, doc)).collect()[0]
    assert list(row.findings_by_type) == ["SAST"] and row.critical == 2 and row.high == 0 and row.gate_passed


def test_artifacts_of_nested_folders(spark, tmp_path):
    (tmp_path / "reports" / "scan-1" / "sbom").mkdir(parents=True)
    (tmp_path / "reports" / "scan-1" / "sbom" / "a.json").write_text("{}")
    (tmp_path / "reports" / "scan-1" / "x.txt").write_text("l1\nl2\n")
    found = artifacts.read_artifacts(spark, str(tmp_path / "reports"))
    assert sorted(values(found, "scan_id", "rel_path", "length")) == [("scan-1", "sbom/a.json", 2), ("scan-1", "x.txt", 6)]
    lines = artifacts.read_report_lines(spark, str(tmp_path / "reports"), "*.txt")
    assert sorted(values(lines, "scan_id", "rel_path", "line")) == [("scan-1", "x.txt", "l1"), ("scan-1", "x.txt", "l2")]


def test_staged_artifacts_read_back(spark, tmp_path):
    df = files(spark, "a", "b")
    artifacts.stage_artifacts(df, str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged")).count() == 2


def test_each_keeps_null_elements_and_drops_padding(spark):
    df = spark.sql("select * from values (1, array(1, null)), (2, array()), (3, null) as t(id, a)")
    assert sorted(values(each(df, ["id"], "a", "x"), "id", "x"), key=str) == [(1, 1), (1, None)]


def test_json_is_parsed_once(spark):
    reports = scanners.read_vuln_reports(files(spark, report()))
    plan = scanners.all_findings(reports)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
