"""Inventories that are read once, dealt by their number of rows, and hold a component once."""

import random

from pyspark.sql import functions as F

from scanlake.operators import totals
from scanlake.plans import bindings, counting, ingest


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_windows_read_their_inventories_once(spark, sf, capsys):
    assert "lineitem" not in plan(counting.sbom_windows(spark, sf), capsys)


def test_distinct_components_in_as_many_tasks_as_asked_for(spark, sf, monkeypatch):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "hot", "hot", None]), r.choice([None, "p", "q", f"x{r.randrange(50)}"])) for _ in range(600)]
    found = spark.createDataFrame(rows, "scan_id string, purl string")
    want = {(s, sum(a == s for a, _ in rows), len({p for a, p in rows if a == s and p})) for s, _ in rows}
    for parts in (None, 9):
        assert {tuple(x)[:3] for x in totals.distinct_components(found, parts).collect()} == want
    assert totals.component_counts(found, 9).rdd.getNumPartitions() == 9
    lines = bindings.table(spark, sf, "lineitem").count()
    assert bindings.component_partitions(spark, sf) is None
    monkeypatch.setattr(bindings, "TASK_ROWS", lines // 10)
    assert bindings.component_partitions(spark, sf) in (10, 11)
    assert counting.sbom_distinct(spark, sf).rdd.getNumPartitions() in (10, 11)


def test_locks_hold_a_component_once_without_a_shuffle_of_its_own(spark, sf, capsys):
    rows = [("s", n, f"p{n}", "1") for n in (1, 2, 2, 2, bindings.BOM_SPAN, bindings.BOM_SPAN)] + [("t", 2, "p2", v) for v in ("1", "2", "1")]
    found = spark.createDataFrame(rows, "scan_id string, ord long, name string, version string").repartition(3)
    got = {(r["scan_id"], r["file"]): [i["key"] for i in r["items"]] for r in bindings._bom_files(found, F.struct(F.col("name").alias("key"), "version"), once=True).collect()}
    assert got == {("s", "sbom-0.json"): ["p1", "p2"], ("s", "sbom-1.json"): [f"p{bindings.BOM_SPAN}"], ("t", "sbom-0.json"): ["p2"]}
    for query in (ingest.lockfile_components, ingest.manifest_components):
        assert plan(query(spark, sf), capsys).count("Exchange hashpartitioning") == 1
