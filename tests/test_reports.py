"""Report folders, test cases at any depth, merged tools, fact tables that are written again, sessions of a hot user."""

import random

from pyspark.sql import functions as F

from scanlake import sinks
from scanlake.operators import joins, ranking, summaries
from scanlake.operators.dedupe import alias_groups, dedupe_findings
from scanlake.session import shared_dir
from scanlake.sources import tests_coverage as tc


def junit(depth):
    inner = '<testcase classname="a.B" name="x &lt;1&gt; > y"><failure message="bad &amp; worse">t</failure><failure message="2"/></testcase><testcase name=\'z\'/>'
    hidden = "<testcase name='last'><system-out><![CDATA[</testcase><testcase name='fake'/>]]></system-out></testcase><!-- <testcase/> --><testcases/>"
    return "<testsuites tests='5'>" + "<testsuite>" * depth + inner + "</testsuite>" * depth + hidden + "</testsuites>"


def test_test_cases_at_any_depth(spark):
    rows = [("s", str(n), junit(n)) for n in (0, 1, 9, 40)] + [("s", "cut", junit(3)[:-20]), ("s", "wrong", "<a><testcase name='q'></a>"), ("s", "none", None), ("s", "empty", ""), ("s", "text", "no xml")]
    found = {r["file"]: r for r in tc.read_junit(spark.createDataFrame(rows, "scan_id string, file string, content string")).collect()}
    for n in ("0", "1", "9", "40"):
        cases = [(c["_classname"], c["_name"], [f["_message"] for f in c["failure"] or []]) for c in found[n]["cases"]]
        assert cases == [("a.B", "x <1> > y", ["bad & worse", "2"]), (None, "z", []), (None, "last", [])] and found[n]["tests"] == 5
    assert all(found[n]["cases"] == [] and found[n]["tests"] == 0 for n in ("cut", "wrong", "none", "empty", "text"))


def folder(spark, files):
    return spark.createDataFrame([(scan, name, text) for scan, own in files.items() for name, text in own.items()], "scan_id string, file string, content string")


def test_summaries_from_folders(spark):
    one = '{"Results": [{"Vulnerabilities": [{"Severity": "critical"}, {"Severity": null}], "Misconfigurations": null}, {"Misconfigurations": [{"Severity": "low"}]}]}'
    files = folder(spark, {
        "images": {"registry-scan-app-1.2.json": one, "registry-scan-base.json": one, "sub/registry-scan-no.json": one, "registry-scan-bad.json": "{", "registry-scan-none.json": "{}"},
        "first": {"trivy-fs-scan.json": "{", "trivy-fs.json": one, "sbom-trivy-cyclonedx.json": '{"components": null}', "secret-scan.json": '{"Results": [{"Secrets": [{}, {}]}, {"Secrets": null}]}'},
        "lists": {"shellcheck.json": "[{}, {}]", "hadolint.json": "{}", "gate-results.txt": "nothing FAILED", "sonarqube-quality-gate.json": '{"status": "warn"}'},
        "whole": {"scan-summary.json": '{"gate_passed": false, "totals": {"high": 3}}', "final-report.json": "{}", "trivy-sca.json": one},
        "local": {"scan-summary.json": "[1]", "final-report.json": '{"summary": {"gate_verdict": {"status": "PASS"}}}', "trivy-sca.json": one},
        "other": {"readme.txt": "x"},
    })
    got = {r["scan_id"]: r for r in summaries.scan_summary_from_files(files).collect()}
    types = lambda scan: {k: tuple(v) for k, v in (got[scan]["findings_by_type"] or {}).items()}
    assert set(got) == {"images", "first", "lists", "whole", "local"}
    assert types("images") == {"registry:app-1.2": (1, 0, 0, 1, 1), "registry:base": (1, 0, 0, 1, 1)} and got["images"]["critical"] == 2 and not got["images"]["gate_passed"]
    assert types("first") == {} and (got["first"]["secrets"], got["first"]["sbom_component_count"], got["first"]["gate_passed"]) == (2, 0, True)
    assert types("lists") == {"shellcheck": (0, 0, 0, 2, 0)} and got["lists"]["quality_gate"] == "WARN" and not got["lists"]["gate_passed"]
    assert (got["whole"]["source"], got["whole"]["high"], got["whole"]["gate_passed"], got["local"]["source"], got["local"]["gate_passed"]) == ("summary", 3, False, "unified", True)
    names = joins.pick_first_present(files.drop("content"))
    assert {r["kind"] for r in names.where("scan_id = 'images'").collect()} == {"registry:app-1.2", "registry:base", "registry:bad", "registry:none"}


def test_alias_groups_are_connected_components(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(170)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(120)] + [("hot", f"h{k}") for k in range(500)] + [(None, "x"), ("y", "y")]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = dict(alias_groups(spark.createDataFrame(pairs, "id string, alias string").repartition(4)).collect())
    assert got == {x: root(x) for x in parent}


def test_merged_tools(spark):
    rows = [("s", "t", "p", "1", "CVE-1", "low", "a"), ("s", "t", "p", "1", "GHSA-1", "HIGH", "b"), ("s", "t", "p", "2", "CVE-1", None, "a"), ("s", "t", "p", "1", "CVE-2", "odd", "a")]
    found = spark.createDataFrame(rows, "scan_id string, target string, package string, installed string, id string, severity_raw string, tool string")
    merged = dedupe_findings(found, spark.createDataFrame([("GHSA-1", "CVE-1")], "id string, alias string"))
    assert sorted((r["installed"], r["identity"], r["severity"], r["tools"], r["reports"]) for r in merged.collect()) == [
        ("1", "CVE-1", "HIGH", ["a", "b"], 2), ("1", "CVE-2", "UNKNOWN", ["a"], 1), ("2", "CVE-1", "UNKNOWN", ["a"], 1)
    ]
    assert dedupe_findings(found).count() == 4


def test_a_day_is_written_again_alone(spark):
    rows = spark.range(300).selectExpr("date_add(date'2024-01-01', cast(id % 30 as int)) as day", "elt(cast(id % 3 + 1 as int), 'a', 'b', 'c') as kind", "id")
    path = f"{shared_dir(spark, 'facts')}/t"
    sinks.write_facts(rows, path)
    sinks.write_facts(rows.where("day = '2024-01-05'").withColumn("id", F.col("id") + 1000), path, tasks=3)
    back = spark.read.schema(rows.schema).parquet(path)
    assert back.count() == 300 and back.where("id >= 1000").select("day").distinct().count() == 1 and back.where("id >= 1000").count() == 10


def test_sessions_of_a_user_with_most_scans(spark):
    r = random.Random(6)
    events = [(1 if r.random() < 0.6 else r.randrange(2, 9), r.randrange(0, 3_000_000) * 1_000_000, k) for k in range(4000)]
    want = []
    for user in {e[0] for e in events}:
        runs = []
        for us in sorted(e[1] for e in events if e[0] == user):
            if runs and us - runs[-1][-1] < 900_000_000:
                runs[-1].append(us)
            else:
                runs.append([us])
        want += [(user, run[0], run[-1], len(run)) for run in runs]
    got = ranking.scan_sessions(spark.createDataFrame(events, "user bigint, us bigint, id bigint"), 900)
    assert sorted(tuple(x) for x in got.select("user", "start_us", "end_us", "scans").collect()) == sorted(want)


def test_kinds_are_looked_up_for_files_and_not_for_the_rows_they_are_made_of(spark, capsys):
    rows = spark.createDataFrame([("s", "trivy-fs", 1, "CRITICAL"), ("s", "trivy-fs", 1, "odd"), ("s", "trivy-fs", 9, "low"), ("s", "other", 1, "HIGH")], "scan_id string, name string, n int, level string")
    report = F.struct(F.array(F.struct(F.transform(F.collect_list("level"), lambda x: F.struct(x.alias("Severity"))).alias("Vulnerabilities"))).alias("Results"))
    packed = rows.groupBy("scan_id", "name", "n").agg(F.to_json(report).alias("content"))
    name = F.when(F.col("n") == 1, F.concat("name", F.lit("-scan.json"))).otherwise(F.concat(F.lit("registry-scan-"), "name", F.lit("-"), "n", F.lit(".json")))
    files = packed.select("scan_id", name.alias("file"), "content")
    types = summaries.report_types(summaries.file_facts(files))
    for plan in (types, summaries.scan_summary_from_files(files), joins.pick_first_present(files)):
        plan.explain()
        assert not [line for line in capsys.readouterr().out.splitlines() if "Filter" in line and "trivy-k8s-config.json" in line]
    assert {r["report"]: tuple(r)[2:] for r in types.collect()} == {"sast": (1, 0, 0, 0, 1), "registry:trivy-fs-9": (0, 0, 0, 1, 0)}
    assert {r["file"] for r in joins.pick_first_present(files).collect()} == {"trivy-fs-scan.json", "registry-scan-trivy-fs-9.json"}
