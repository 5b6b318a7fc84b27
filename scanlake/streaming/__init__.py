"""Streaming forms of the operators, each with a batch twin elsewhere in the package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.operators.builds import AGENT_TTL_SECONDS
from scanlake.session import STREAM_SETTINGS
from scanlake.sources.tail import LogTail
from scanlake.streaming import keyed


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """``STREAM_SETTINGS`` for the time a stream starts and runs, in sessions that were not built with them."""
    before = {key: spark.conf.get(key, None) for key in STREAM_SETTINGS}
    changed = {key: value for key, value in STREAM_SETTINGS.items() if before[key] != value}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in changed:
            spark.conf.unset(key) if before[key] is None else spark.conf.set(key, before[key])


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream; the schema is the table's own, read once from its footer.

    The stream source takes a single file only through a glob, so the last character is given as one.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_append(stream: DataFrame, root: str) -> DataFrame:
    """Process what is available into an exactly-once Parquet sink and return the sink as a table."""
    spark = stream.sparkSession
    with _settings(spark):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{root}/out")
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_complete(stream: DataFrame, root: str) -> DataFrame:
    """Process what is available and return the last full result of a small aggregate.

    Every batch overwrites its own folder, so a batch that is run again after a failure does no harm.
    """
    written: list[int] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        written.append(batch_id)

    query = (
        stream.writeStream.foreachBatch(save)
        .outputMode("complete")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    if written:
        return spark.read.schema(stream.schema).parquet(f"{root}/out/batch={written[-1]}")
    try:  # nothing new since a restart: the last result is still the one that holds
        before = spark.read.parquet(f"{root}/out")
    except AnalysisException:
        return spark.createDataFrame([], stream.schema)
    last = before.agg(F.max("batch")).first()[0]
    return spark.read.schema(stream.schema).parquet(f"{root}/out/batch={last}")


def tail_log(chunks: DataFrame, root: str) -> DataFrame:
    """Console chunks (build, offset, text), each taken once; the checkpoint stands for the byte offset."""
    sized = chunks.select("build", "offset", F.octet_length("text").cast("bigint").alias("bytes"), "text")
    return run_append(sized, root)


def read_growing_logs(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Blocks of whole lines (file, offset, text) appended to the files of a folder, as a stream."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log-tail").options(path=folder, **options).load()


def tail_files(spark: SparkSession, folder: str, root: str, **options: object) -> DataFrame:
    """All blocks read so far; called again with the same ``root`` it goes on where the files ended before."""
    return run_append(read_growing_logs(spark, folder, **options), root)


def stream_phase_changes(chunks: DataFrame, root: str, keep_ms: int = keyed.DAY_MS) -> DataFrame:
    """Phase changes per build over a stream of chunks (build, offset, text); see ``keyed.phase_changes``."""
    return run_append(keyed.phase_changes(chunks, keep_ms), root)


def stream_phase_log(records: DataFrame, root: str) -> DataFrame:
    """Phase records as they are appended: count and total time per phase and status."""
    totals = records.groupBy("name", "status").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms")
    )
    return run_complete(totals, root)


def await_terminal(builds: DataFrame, root: str, remember: str = "7 days") -> DataFrame:
    """Each build once, when it is first seen finished; see ``keyed.finished_builds``."""
    return run_append(keyed.finished_builds(builds, "ts", remember), root)


def stale_agents(events: DataFrame, root: str, ttl_seconds: int = AGENT_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Agents whose time to live has run out in event time.

    ``events`` is (agent, ts, action) with action ``create`` or ``destroy``. An agent is a session that ends one
    time to live after its last event; it comes out when the watermark passes that end, unless it was destroyed.
    """
    lives = (
        events.withWatermark("ts", delay)
        .groupBy("agent", F.session_window("ts", f"{ttl_seconds} seconds").alias("life"))
        .agg(F.max("ts").alias("last_seen"), F.max_by("action", F.struct("ts", "action")).alias("last_action"))
    )
    ended = lives.where("last_action = 'create'").select("agent", "last_seen", F.col("life.end").alias("expired"))
    return run_append(ended, root)


def active_agents(events: DataFrame, root: str, limit: int) -> DataFrame:
    """Agents alive per pool against the limit: those whose last event, in its pool, is a creation.

    The stream appends changes (``keyed.agent_changes``); the gauge is their sum, so neither a batch nor the state grows with agents
    that are gone.
    """
    changes = run_append(keyed.agent_changes(events), root)
    gauge = changes.groupBy("pool").agg(F.sum("change").cast("bigint").alias("active"))
    return gauge.withColumn("at_limit", F.col("active") >= limit)


def windowed_findings(findings: DataFrame, root: str, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Findings per window and severity; rows later than ``delay`` are dropped and open windows are not given."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counts = (
        findings.withWatermark("ts", delay).groupBy(window.alias("w"), "severity").agg(F.count("*").alias("n"))
    )
    return run_append(counts.select(F.col("w.start").alias("bucket"), "severity", "n"), root)


def scan_sessions(events: DataFrame, root: str, gap_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(user, start_us, end_us, scans): sessions of (user, ts) that ended before the watermark; the twin of ``ranking.scan_sessions``."""
    sessions = events.withWatermark("ts", delay).groupBy("user", F.session_window("ts", f"{gap_seconds} seconds").alias("life")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("scans")
    )
    return run_append(sessions.select("user", F.unix_micros("first").alias("start_us"), F.unix_micros("last").alias("end_us"), "scans"), root)
