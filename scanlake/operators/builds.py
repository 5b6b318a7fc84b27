"""Builds, phases, agents, health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake import schemas
from scanlake.functions.rows import each
from scanlake.functions.timing import duration_ms, from_epoch_ms, result_label, running_result, whole_seconds
from scanlake.sources.textual import last_of_each

# Time to live and number limit of agents.
AGENT_TTL_SECONDS = 7200
MAX_AGENTS = 10


def build_detail(df: DataFrame) -> DataFrame:
    """Build documents to typed rows: parameters of all actions as one map, artifacts as a list, empty ones null."""
    doc = df.withColumn("d", F.from_json("content", schemas.BUILD, {"mode": "PERMISSIVE"}))
    entries = F.flatten(
        F.transform(F.coalesce("d.actions", F.array()), lambda a: F.coalesce(a["parameters"], F.array()))
    )
    named = F.transform(
        entries, lambda p: F.struct(F.coalesce(p["name"], F.lit("")).alias("key"), p["value"].alias("value"))
    )
    artifacts = F.coalesce("d.artifacts", F.array())
    return last_of_each(doc, named, "params").select(
        "job",
        F.coalesce("d.number", F.lit(0)).alias("number"),
        F.col("d.result").alias("result"),
        F.coalesce("d.building", F.lit(False)).alias("building"),
        F.col("d.timestamp").alias("timestamp_ms"),
        F.col("d.duration").alias("duration_ms"),
        F.col("d.url").alias("url"),
        F.when(F.size("params") > 0, F.map_from_entries("params")).alias("params"),
        F.when(F.size(artifacts) > 0, artifacts).alias("artifacts"),
    )


def build_history(builds: DataFrame) -> DataFrame:
    """How a build is listed: start time, whole seconds, shown result."""
    return builds.select(
        "job",
        "number",
        from_epoch_ms(F.col("timestamp_ms")).alias("started"),
        whole_seconds(F.col("duration_ms")).alias("seconds"),
        running_result(F.col("result")).alias("result"),
        result_label(F.col("result")).alias("label"),
    )


def build_status(resolved: DataFrame, builds: DataFrame) -> DataFrame:
    """State of the build that a scan id resolved to."""
    state = builds.select(
        F.col("job").alias("pipeline"), "number", "building", "result", "duration_ms", "timestamp_ms"
    )
    return resolved.join(state, ["pipeline", "number"], "left")


def build_metrics(builds: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Scan count, error count and mean duration per job and time bucket."""
    return builds.groupBy("job", F.window("ts", bucket).alias("w")).agg(
        F.count("*").alias("scans"),
        F.count_if(F.col("result") == "FAILURE").alias("failures"),
        F.avg("duration_ms").alias("avg_duration_ms"),
    ).select("job", F.col("w.start").alias("bucket"), "scans", "failures", "avg_duration_ms")


def agent_counts(df: DataFrame) -> DataFrame:
    """Nodes online, in all and busy; an unknown state reads offline and idle."""
    doc = F.from_json("content", schemas.NODES, {"mode": "PERMISSIVE"})
    nodes = each(df, ["pool"], doc["computer"], "c")
    return nodes.groupBy("pool").agg(
        F.count_if(~F.coalesce("c.offline", F.lit(True))).alias("online"),
        F.count("*").alias("total"),
        F.count_if(~F.coalesce("c.idle", F.lit(True))).alias("busy"),
    )


def readiness(checks: DataFrame) -> DataFrame:
    """Ready when every dependency answered below 500; no answer (null status) is not ok."""
    ok = F.coalesce(F.col("status") < 500, F.lit(False))
    return checks.groupBy("system").agg(F.bool_and(ok).alias("ready"), F.count_if(ok).alias("ok_checks"))


def phase_durations(phases: DataFrame) -> DataFrame:
    """Phase records with ISO times: their length in whole milliseconds."""
    return phases.withColumn(
        "duration_ms", duration_ms(F.to_timestamp("started_at"), F.to_timestamp("ended_at"))
    )


def stale_agents(agents: DataFrame, now: Column, ttl_seconds: int = AGENT_TTL_SECONDS) -> DataFrame:
    """Agents older than the time to live; those without a creation time never are."""
    age = F.unix_seconds(now) - F.unix_seconds("created")
    return agents.where(age > ttl_seconds).withColumn("age_minutes", F.floor(age / 60).cast("bigint"))
