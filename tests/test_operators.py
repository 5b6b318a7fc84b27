"""Operators on small fixtures: brute force, hot keys, verdict tables."""

import itertools
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scanlake import streaming
from scanlake.functions import paths, text
from scanlake.functions.severity import severity_filter
from scanlake.operators import gates, inventory, joins, ranking, rules, totals
from scanlake.operators.skew import sliced_window


@pytest.fixture(scope="module")
def hot(spark):
    """A key with most of the rows, gaps in its order, and null values."""
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 900), ("warm", 60), ("cold", 1)):
        for place in sorted(rng.sample(range(5000), n)):
            rows.append((key, place, rng.choice(["a", "b", None]), rng.randrange(10)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, o bigint, v string, n bigint").repartition(4)


@pytest.mark.parametrize("span", [1.0, 7.0, 500.0, 1e9])
def test_sliced_windows_equal_plain_ones(hot, span):
    w = W.partitionBy("k").orderBy("o")
    plain = hot.select("k", "o", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"), F.lag("v").over(w).alias("before"))
    sliced = sliced_window(hot, ["k"], ["o"], F.col("o"), span, {"total": F.col("n")}, {"before": "v"})
    assert sorted(sliced.select("k", "o", "total", "before").collect(), key=str) == sorted(plain.collect(), key=str)


def test_top_k_keeps_few_rows_per_task_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("concat('s', id % 1) as scan_id", "id as ord", "'LOW' as severity")
    plan = ranking.top_findings(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    rows = ranking.top_findings(df, 5).collect()
    assert [r.ord for r in sorted(rows, key=lambda r: r.rank)] == [0, 1, 2, 3, 4] and {r.more for r in rows} == {95}


def test_severity_filter_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").where(severity_filter("o_orderpriority", "1-URGENT"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in plan


def test_find_equals_regex(spark):
    patterns = ["(?i)abc|x.*y|Q", "abc|x.*y", "(?i)(a|b).*:", "^#!", "a b", "(?i)é|token", "mem_limit|memory:"]
    texts = ["", "ABC", "x1y", "x\ny", "y x", "q", "#!/bin", " #!", "A B", "a b: c", "TOKEN", "É", "memory:", "zz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in patterns:
        rows = df.select("t", text.find(F.col("t"), pattern).alias("a"), F.col("t").rlike(pattern.replace("(?i)é", "(?iu)é")).alias("b")).collect()
        assert [r for r in rows if r.a != r.b] == [], pattern


def test_first_phase_rule_wins(spark):
    df = spark.createDataFrame([("Trivy then clone",), ("docker\nbuild",), ("docker x BUILD",), ("kubectl  apply",), ("zz",)], "t string")
    assert [r[0] for r in df.select(rules.detect_phase("t")).collect()] == [
        "Checking out source code", None, "Building container image", "Deploying to Kubernetes", None,
    ]


def verdict(spark, column, **values):
    kinds = {int: "bigint", float: "double", bool: "boolean", str: "string"}
    fields = ", ".join(f"{k} {kinds.get(type(v), 'bigint')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], fields).select(column).collect()[0][0]


def test_gate_tables(spark):
    base = {"critical": 0, "high": 0, "secrets": 0, "blockers": 0, "test_failed": 0}
    assert verdict(spark, gates.comprehensive(), **base) == "PASS"
    assert verdict(spark, gates.comprehensive(), **{**base, "high": 10}) == "PASS"
    assert verdict(spark, gates.comprehensive(), **{**base, "high": 11}) == "WARNING"
    assert verdict(spark, gates.comprehensive(), **{**base, "secrets": 1}) == "FAIL"
    assert verdict(spark, gates.full_scan(console=True), **{**base, "secrets": 1}) == "PASS"
    assert verdict(spark, gates.full_scan(), **{**base, "secrets": 1}) == "FAIL"
    assert verdict(spark, gates.tri_state(), critical=0, high=1) == "WARN"


def test_unified_gate(spark):
    def run(strict, critical=0, failed=0, pct=None, warnings=0):
        df = spark.createDataFrame([(critical, failed, pct)], "critical bigint, test_failed bigint, coverage_pct double")
        reasons = gates.unified_reasons()
        row = df.select(reasons.alias("r"), gates.unified_status(reasons, F.lit(warnings), F.lit(strict)).alias("s")).collect()[0]
        return row.s, row.r

    assert run(True) == ("PASS", [])
    assert run(True, warnings=1) == ("DEGRADED", [])
    assert run(False, critical=2) == ("DEGRADED", ["critical findings: 2"])
    assert run(True, failed=1, pct=69.9) == ("FAIL", ["failed tests/errors: 1", "coverage below threshold: 69.9% < 70.0%"])
    assert run(True, pct=70.0) == ("PASS", [])


def test_gate_file_fallbacks(spark):
    cases = [("GATE_STATUS=PASS\nx=fail", 5, True), ("GATE_STATUS=pass", 0, True), ("GATE_STATUS=FAIL", 0, False), ("CRITICAL=3", 3, True),
             ("it FAILED", 0, False), (None, 1, False), (None, 0, True), ("GATE_STATUS=PASS\nGATE_STATUS=FAIL", 0, False)]
    df = spark.createDataFrame([(t, c) for t, c, _ in cases], "gate_text string, critical bigint").coalesce(1)
    assert [r[0] for r in df.select(gates.from_gate_file()).collect()] == [want for _, _, want in cases]


def test_policies_disagree_as_listed(spark):
    rows = [("s", k, v) for k, v in itertools.product(("vuln", "misconfig", "secret"), ("CRITICAL", "high", None, "odd"))]
    df = spark.createDataFrame(rows, "scan_id string, kind string, severity_raw string")
    got = {p: tuple(totals.severity_totals(df, policy=p).collect()[0][1:]) for p in totals.POLICIES}
    assert got["api"] == (2, 2, 0, 0, 4, 4, 1, 1)
    assert got["unified"] == (3, 4, 0, 0, 5, 4, 1, 1)
    assert got["gate"] == (1, 1, 0, 0, 0, 4, 1, 1)
    assert got["gate_strict"] == (1, 0, 0, 0, 0, 4, 1, 0)
    assert got["critical_only"] == (1, 0, 0, 0, 0, 4, 1, 0)


def test_resolve_scan_dir_prefers_exact_then_greatest(spark):
    folders = spark.createDataFrame([("abc",), ("abc-1",), ("abd-1",), ("abd-2",), ("ab",)], "folder string")
    requests = spark.createDataFrame([("abc",), ("abd",), ("zzz",), ("ab",)], "requested string")
    got = {r.requested: (r.folder, r.how) for r in joins.resolve_scan_dir(requests, folders, "old").collect()}
    assert got["abc"] == ("abc", "exact") and got["abd"] == ("abd-2", "prefix") and got["zzz"] == ("old", "legacy")


def test_registrations_follow_their_order(spark):
    def expect(rows):
        table = {}
        for scan, pipeline, number, _ in sorted(rows, key=lambda r: r[3]):
            table[scan] = (pipeline, number)
            for suffix in joins.PIPELINE_SUFFIXES:
                if scan.endswith(suffix):
                    table.setdefault(scan[: -len(suffix)], (pipeline, number))
                    break
        return table

    rng = random.Random(3)
    ids = ["a", "b", "a-ci-cd-pipeline", "a-devsecops-pipeline", "b-security-scan-pipeline"]
    for _ in range(3):
        rows = [(rng.choice(ids), f"p{i}", i * 10, i) for i in range(8)]
        df = spark.createDataFrame(rows, "scan_id string, pipeline string, number bigint, seq bigint")
        got = {r.scan_id: (r.pipeline, r.number) for r in joins.register_builds(df).collect()}
        assert got == expect(rows)


def test_suppression_needs_a_reason(spark):
    findings = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    accepted = spark.createDataFrame([("a", "known"), ("b", " "), ("c", None)], "id string, reason string")
    assert sorted(r.id for r in joins.suppress(findings, accepted).collect()) == ["b", "c"]


def test_paths(spark):
    cases = {"a/../b": True, "../a": False, "a/../../b": False, "/abs": False, "./a/./b": True, "a/b/../../..": False, "": True}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.ok for r in df.select("p", paths.safe_relative("p").alias("ok")).collect()} == cases
    visible = {"x.log": False, "a/b.tmp": False, "Console-Log-1.txt": False, ".log": True, "report.json": True, "a.log/x.json": True}
    df = spark.createDataFrame([(p,) for p in visible], "p string")
    assert {r.p: r.ok for r in df.select("p", paths.artifact_visible("p").alias("ok")).collect()} == visible


def project(spark, *entries):
    rows = [("p", path, content) for path, content in entries]
    return spark.createDataFrame(rows, "project string, path string, content string")


def test_adapters(spark):
    df = project(spark, ("package.json", '{"React": 1}'), ("Makefile", ""), ("src/a.cc", ""), ("docs/x.html", ""), ("k/A.kt", ""))
    got = {r.adapter: list(r.signals) for r in inventory.detect_adapters(df).collect()}
    assert got == {"node-react": ["package.json", "react-dependency"], "c-cpp": ["Makefile"], "html-static": ["*.html"], "kotlin": ["*.kt"]}
    assert inventory.detect_adapters(project(spark, ("Makefile", ""), ("b/pom.xml", ""))).count() == 0


@pytest.mark.parametrize(
    "entries, module, python_first, fallback",
    [
        ([("pom.xml", ""), ("setup.py", "")], "java-maven", "python", "python"),
        ([("package.json", '"vue"')], "vue", "nodejs", "vue"),
        ([("package.json", '"react-dom"')], "react", "nodejs", "nodejs"),
        ([("next.config.js", ""), ("go.mod", "")], "go", "react", "go"),
        ([("a.csproj", "")], "dotnet", "dotnet", "dotnet"),
        ([("README", "")], None, "nodejs", "python"),
    ],
)
def test_languages(spark, entries, module, python_first, fallback):
    df = project(spark, *entries)
    got = [inventory.detect_language(df, v).collect()[0].language for v in ("module", "python_first", "fallback")]
    assert got == [module, python_first, fallback]


def test_test_dirs_per_language(spark):
    df = project(
        spark, ("py/setup.py", ""), ("py/tests/conftest.py", ""), ("py/x/conftest.py", ""), ("py/y/test_a.py", ""), ("js/package.json", ""),
        ("js/spec/unit/deep.txt", ""), ("js/src/a.test.ts", ""), ("js/node_modules/test/a.js", ""), ("jv/pom.xml", ""), ("jv/src/test/java/A.java", ""),
        ("jv/src/main/B.java", ""), ("g/go.mod", ""), ("g/pkg/a_test.go", ""),
    )
    modules = inventory.discover_modules(df)
    got = {(r.module, r.dir) for r in inventory.test_dirs(df.drop("content"), modules).collect()}
    assert got == {("py", "py/tests"), ("py", "py/y"), ("js", "js/spec"), ("js", "js/src"), ("jv", "jv/src/test/java"), ("g", "g/pkg")}


def test_root_gives_up_files_of_children(spark):
    owned = spark.createDataFrame([("p", "root", "a/D"), ("p", "root", "D"), ("p", "a", "a/D"), ("q", "root", "a/D")], "project string, module string, path string")
    got = {tuple(r) for r in inventory.remove_root_duplicates(owned).collect()}
    assert got == {("p", "root", "D"), ("p", "a", "a/D"), ("q", "root", "a/D")}


def test_directory_tree(spark):
    df = project(spark, ("a/b/x", ""), ("y", ""), ("node_modules/z/q", "")).drop("content")
    assert sorted(r.dir for r in inventory.directory_tree(df).collect()) == [".", "./a", "./a/b"]


def test_phase_stream_over_many_batches_equals_one(spark, tmp_path):
    rng = random.Random(5)
    words = ["git clone", "pytest", "sbom", "nothing"]
    rows = [(build, offset, rng.choice(words)) for build in (1, 2, 3) for offset in range(40)]
    for part in range(4):  # later files hold later offsets
        chunk = [r for r in rows if r[1] // 10 == part]
        spark.createDataFrame(chunk, "build bigint, offset bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.read_table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = {tuple(r) for r in streaming.stream_phase_changes(stream, str(tmp_path / "run")).collect()}
    batch = spark.createDataFrame(rows, "build bigint, offset bigint, text string").select("build", "offset", rules.detect_phase("text").alias("phase"))
    want = {(r.build, r.offset, r.phase) for r in ranking.phase_changes(batch).collect()}
    assert got == want
    # several micro-batches; their state lies in the checkpoint now
    assert len(list((tmp_path / "run" / "checkpoint" / "commits").glob("[0-9]*"))) > 1


def test_tail_reads_nothing_twice(spark, tmp_path):
    schema = "build bigint, offset bigint, text string"
    source, root = str(tmp_path / "in"), str(tmp_path / "run")
    spark.createDataFrame([(1, 0, "a")], schema).coalesce(1).write.parquet(source)
    assert streaming.tail_log(streaming.read_table_stream(spark, source), root).count() == 1
    spark.createDataFrame([(1, 1, "bb")], schema).coalesce(1).write.mode("append").parquet(source)
    rows = streaming.tail_log(streaming.read_table_stream(spark, source), root).collect()
    assert sorted((r.offset, r.bytes) for r in rows) == [(0, 1), (1, 2)]


def test_has_tests_by_language(spark):
    cases = {
        "python": ({"a/b/test_x.py": True, "a/b/c/test_x.py": False, "tests/x": True, "a/tests/x": False}),
        "java-maven": {"src/test/A.java": True, "a/b/XIT.java": True, "a/src/test/A.java": False},
        "react": {"spec/a": True, "a/x.spec.ts": True, "node_modules/a.test.js": False},
        "go": {"a/b_test.go": True, "test/x": False},
        "dotnet": {"a/MyTest.csproj": True, "A.Tests/x.cs": True, "a/x.cs": False},
        "other": {"test/x": True, "spec/x": False},
    }
    for language, paths_of in cases.items():
        for i, (path, want) in enumerate(paths_of.items()):
            df = spark.createDataFrame([("p", path)], "project string, path string")
            languages = spark.createDataFrame([("p", language)], "project string, language string")
            assert inventory.has_tests(df, languages).collect()[0].has_tests is want, (language, path)


def test_usable_sources(spark):
    from scanlake.sources.artifacts import non_empty_object

    cases = {'{"a":1}': True, "{}": False, "{bad": False, "[]": False, "": False, '"x"': False}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.ok for r in df.select("c", non_empty_object("c").alias("ok")).collect()} == cases
