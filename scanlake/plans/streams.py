"""Queries that run a stream over what is available and give its sink as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake import sinks, streaming
from scanlake.operators import ranking
from scanlake.operators.builds import MAX_AGENTS
from scanlake.plans import bindings as b
from scanlake.plans import content
from scanlake.plans.registry import query
from scanlake.session import shared_dir


def event_stream(spark, sf):
    return b.event_rows(streaming.read_table_stream(spark, f"{sf}/events.parquet"))


def chunk_stream(spark, sf):
    return b.chunk_rows(streaming.read_table_stream(spark, f"{sf}/conversations.parquet"))


@query(
    "tail_log",
    "ST1",
    f"""with {b.CHUNKS_SQL} select build, count(*) as chunks, cast(sum(strlen(text)) as bigint) as bytes from chunks group by build""",
)
def tail_log(spark, sf):
    rows = streaming.tail_log(chunk_stream(spark, sf), shared_dir(spark, "tail"))
    return rows.groupBy("build").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"))


@query(
    "tail_files",
    "ST1",
    f"""with {b.CHUNKS_SQL} select build % 8 as log, cast(sum(strlen(text) + 1) as bigint) as bytes, cast(sum(strlen(text) - strlen(replace(text, chr(10), '')) + 1) as bigint) as lines from chunks group by 1""",
)
def tail_files(spark, sf):
    """Console logs as files, one folder for each of eight agents, read by byte ranges."""
    logs = b.chunk_rows(b.table(spark, sf, "conversations")).select((F.col("build") % 8).alias("log"), F.coalesce("text", F.lit("")).alias("value"))
    folder = shared_dir(spark, "console")
    sinks.write_documents(logs, folder, "logs", "log")
    rows = streaming.tail_files(spark, f"{folder}/logs", shared_dir(spark, "tail-files"), suffix=".txt", range_bytes=65536, block_bytes=4096)
    text = F.col("text")
    return rows.groupBy(F.regexp_extract("file", r"log=(\d+)/", 1).cast("bigint").alias("log")).agg(
        F.sum(F.octet_length(text)).cast("bigint").alias("bytes"), F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint").alias("lines")
    )


@query(
    "stream_phase_changes",
    "ST2",
    f'with {content.CHANGES_SQL} select build, "offset", phase from marked where phase is distinct from previous',
)
def phase_changes(spark, sf):
    return streaming.stream_phase_changes(chunk_stream(spark, sf), shared_dir(spark, "phases"))


@query(
    "stream_phase_log",
    "ST3",
    f"""with {b.EVENTS_SQL} select event_type as name, coalesce(result, 'RUNNING') as status, count(*) as n, cast(sum(duration_ms) as bigint) as total_ms, max(duration_ms) as max_ms from builds group by all""",
)
def phase_log(spark, sf):
    records = event_stream(spark, sf).select(
        F.col("event_type").alias("name"), F.coalesce("result", F.lit("RUNNING")).alias("status"), "duration_ms"
    )
    return streaming.stream_phase_log(records, shared_dir(spark, "phaselog"))


@query(
    "await_terminal",
    "ST4",
    f"""with {b.EVENTS_SQL} select job, number, result from builds where not building""",
)
def await_terminal(spark, sf):
    """Every build is reported twice; it comes out once."""
    seen = event_stream(spark, sf).select("job", "number", "result", "building", "ts")
    twice = seen.withColumn("poll", F.explode(F.array(F.lit(1), F.lit(2)))).drop("poll")
    return streaming.await_terminal(twice, shared_dir(spark, "terminal")).select("job", "number", "result")


def agent_events(spark, sf):
    action = F.when(F.col("event_type") == "purchase", "destroy").otherwise("create")
    return event_stream(spark, sf).select(
        F.concat(F.lit("scan-agent-"), F.col("user_id").cast("string")).alias("agent"), F.col("job").alias("pool"), "ts", action.alias("action")
    )


@query(
    "stream_stale_agents",
    "ST5",
    f"""with {b.EVENTS_SQL}, g as (select *, case when ts - lag(ts) over w < interval '7200 seconds' then 0 else 1 end as fresh from builds window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as life from g),
    l as (select user_id, life, max(ts) as last_seen, arg_max(event_type, ts) as last_type from s group by user_id, life)
    select 'scan-agent-' || user_id as agent, epoch_us(last_seen) as last_us from l where last_type <> 'purchase'
      and last_seen + interval '7200 seconds' <= (select max(ts) - interval '10 minutes' from builds)""",
)
def stream_stale_agents(spark, sf):
    rows = streaming.stale_agents(agent_events(spark, sf), shared_dir(spark, "stale"))
    return rows.select("agent", F.unix_micros("last_seen").alias("last_us"))


@query(
    "active_agents",
    "ST6",
    f"""with {b.EVENTS_SQL}, l as (select job as pool, user_id, arg_max(event_type = 'purchase', (ts, event_type = 'purchase')) as gone from builds group by job, user_id),
    a as (select pool, count(*) filter (not gone) as active from l group by pool)
    select pool, cast(active as bigint) as active, cast(active >= 10 as varchar) as at_limit from a""",
)
def active_agents(spark, sf):
    rows = streaming.active_agents(agent_events(spark, sf), shared_dir(spark, "active"), MAX_AGENTS)
    return rows.withColumn("at_limit", F.col("at_limit").cast("string"))


def finding_stream(spark, sf):
    level = (
        F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "view", "HIGH")
        .when(F.col("event_type") == "click", "UNKNOWN").otherwise("LOW")
    )
    return event_stream(spark, sf).select("ts", level.alias("severity"))


LEVEL_SQL = "case event_type when 'error' then 'CRITICAL' when 'view' then 'HIGH' when 'click' then 'UNKNOWN' else 'LOW' end"


@query(
    "windowed_findings",
    "ST7",
    f"""select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as bucket, {LEVEL_SQL} as severity, count(*) as n from events
    group by time_bucket(interval '1 hour', ts), severity having time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)""",
)
def windowed(spark, sf):
    rows = streaming.windowed_findings(finding_stream(spark, sf), shared_dir(spark, "windows"))
    return rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


@query(
    "sliding_findings",
    "ST7",
    f"""with w as (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as b, {LEVEL_SQL} as severity from events)
    select strftime(b, '%Y-%m-%d %H:%M') as bucket, severity, count(*) as n from w group by b, severity having b + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)""",
)
def sliding(spark, sf):
    rows = streaming.windowed_findings(finding_stream(spark, sf), shared_dir(spark, "sliding"), "1 hour", "30 minutes")
    return rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


SESSIONS_SQL = f"""{b.EVENTS_SQL}, u as (select case when number % 3 = 0 then -1 else user_id end as person, ts, number from builds),
gaps as (select *, case when ts - lag(ts) over w < interval '900 seconds' then 0 else 1 end as fresh from u window w as (partition by person order by ts, number)),
numbered as (select *, sum(fresh) over (partition by person order by ts, number rows unbounded preceding) as session from gaps),
sessions as (select person as "user", epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us, count(*) as scans, max(ts) as last from numbered group by person, session)"""


def scans_of_users(events):
    """A third of all scans belong to one user."""
    return events.select(F.when(F.col("number") % 3 == 0, -1).otherwise(F.col("user_id")).cast("bigint").alias("user"), "ts", F.unix_micros("ts").alias("us"), F.col("number").alias("id"))


@query("scan_sessions", "ST8", f'with {SESSIONS_SQL} select "user", start_us, end_us, scans from sessions')
def sessions(spark, sf):
    return ranking.scan_sessions(scans_of_users(b.events(spark, sf)), 900)


@query(
    "stream_scan_sessions",
    "ST8",
    f"""with {SESSIONS_SQL} select "user", start_us, end_us, scans from sessions where last + interval '900 seconds' <= (select max(ts) - interval '10 minutes' from builds)""",
)
def stream_sessions(spark, sf):
    return streaming.scan_sessions(scans_of_users(event_stream(spark, sf)), shared_dir(spark, "sessions"), 900)
