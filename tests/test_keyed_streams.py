"""Streams over several micro-batches, with restarts and with state that ends."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scanlake import streaming
from scanlake.session import shared_dir
from scanlake.streaming import keyed

NOON = dt.datetime(2024, 5, 1, 12)
PHASES = {"c": "git clone x", "t": "pytest -q", "-": "nothing to see"}


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(spark, stream, root):
    """Runs what is available; the number of rows in the state after each batch."""
    with streaming._settings(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
        query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def rows_of(spark, stream, root):
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{root}/out").collect())


def test_phase_changes_over_batches_and_a_restart(spark):
    folder, root, schema = shared_dir(spark, "chunks"), shared_dir(spark, "run"), "build bigint, offset bigint, text string, at timestamp"

    def chunks(build, first, marks, minute):
        return [(build, first + k, PHASES[m], NOON + dt.timedelta(minutes=minute)) for k, m in enumerate(marks)]

    put(spark, folder, "a", chunks(1, 0, "cc-ct", 0) + chunks(2, 0, "--", 0) + chunks(3, 0, "c", 0), schema)
    put(spark, folder, "b", chunks(1, 4, "tt-t", 1) + chunks(2, 2, "tc", 1), schema)  # offset 4 of build 1 comes again
    stream = keyed.phase_changes(source(spark, folder, schema), 10 * 60_000, seen=F.col("at"))
    run(spark, stream, root)
    clone, test = (rows_of(spark, stream, root)[k][2] for k in (0, 1))
    assert clone != test and rows_of(spark, stream, root) == [(1, 0, clone), (1, 4, test), (2, 2, test), (2, 3, clone), (3, 0, clone)]
    put(spark, folder, "c", chunks(1, 8, "tct", 2), schema)
    put(spark, folder, "d", chunks(4, 0, "c", 60), schema)
    put(spark, folder, "e", chunks(5, 0, "t", 61), schema)  # timers go off behind the rows of a batch
    put(spark, folder, "f", chunks(3, 1, "c", 62), schema)
    state = run(spark, keyed.phase_changes(source(spark, folder, schema), 10 * 60_000, seen=F.col("at")), root)
    assert state[0] >= 3 and state[-1] <= 3  # builds 1 and 2 are forgotten an hour later, and 3 begins anew
    assert rows_of(spark, stream, root)[2:4] == [(1, 9, clone), (1, 10, test)] and (3, 1, clone) in rows_of(spark, stream, root)
    run(spark, keyed.phase_changes(source(spark, folder, schema), 10 * 60_000, seen=F.col("at")), root)
    assert len(rows_of(spark, stream, root)) == 10


def test_finished_builds_leave_the_state(spark):
    folder, root, schema = shared_dir(spark, "builds"), shared_dir(spark, "run"), "job string, number bigint, building boolean, ts timestamp"
    hour = lambda n: NOON + dt.timedelta(hours=n)
    put(spark, folder, "a", [("j", k, False, hour(0)) for k in range(50)] + [("j", 99, True, hour(0))], schema)
    put(spark, folder, "b", [("j", 3, False, hour(1)), ("j", 99, False, hour(1))], schema)
    put(spark, folder, "c", [("j", 1000, False, hour(30))], schema)
    put(spark, folder, "d", [("j", 1001, False, hour(31))], schema)
    stream = keyed.finished_builds(source(spark, folder, schema), "ts", "2 hours")
    state = run(spark, stream, root)
    assert sorted(r[1] for r in rows_of(spark, stream, root)) == [*range(50), 99, 1000, 1001]
    assert max(state) >= 50 and state[-1] <= 2


def test_agents_that_are_gone_leave_the_state(spark):
    folder, root, schema = shared_dir(spark, "agents"), shared_dir(spark, "run"), "pool string, agent string, ts timestamp, action string"
    at = lambda n: NOON + dt.timedelta(minutes=n)
    put(spark, folder, "a", [("p", f"a{k}", at(0), "create") for k in range(30)] + [("q", "z", at(0), "destroy"), ("q", "z", at(0), "create")], schema)
    put(spark, folder, "b", [("p", f"a{k}", at(1), "destroy") for k in range(28)] + [("p", "a29", at(0), "create")], schema)
    put(spark, folder, "c", [("p", "a3", at(0), "create"), ("p", "a4", at(5), "create")], schema)  # a3 comes too late to live again
    put(spark, folder, "d", [("p", "b", at(60), "create")], schema)
    put(spark, folder, "e", [("p", "c", at(61), "create")], schema)
    stream = keyed.agent_changes(source(spark, folder, schema))
    state = run(spark, stream, root)
    found = spark.read.schema(stream.schema).parquet(f"{root}/out")
    assert {r[0]: r[1] for r in found.groupBy("pool").agg(F.sum("change")).collect()} == {"p": 5, "q": 0}
    assert found.where("change = 0").count() == 1 and max(state) >= 31 and state[-1] <= 6


def test_appended_bytes_come_out_once(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "run")
    (logs / "x").mkdir(parents=True)
    (logs / "x" / "one.log").write_text("".join(f"line {k} é\n" for k in range(500)) + "half a li")
    (logs / "two.log").write_text("")

    def text(name):
        found = streaming.tail_files(spark, str(logs), root, suffix=".log", range_bytes=700, block_bytes=128)
        blocks = sorted(tuple(r) for r in found.where(F.col("file") == name).select("offset", F.encode("text", "utf-8").alias("b")).collect())
        out = b""
        for at, block in blocks:
            assert at == len(out) and block.endswith(b"\n")
            out += block
        return out.decode()

    first = "".join(f"line {k} é\n" for k in range(500))
    assert text("x/one.log") == first
    with open(logs / "x" / "one.log", "a") as log:
        log.write("ne\nlast\n")
    (logs / "two.log").write_text("z" * 5000 + "\n")
    assert text("x/one.log") == first + "half a line\nlast\n"
    assert text("two.log") == "z" * 5000 + "\n" and text("x/one.log") == first + "half a line\nlast\n"
