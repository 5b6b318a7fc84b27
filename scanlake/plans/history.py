"""Queries over builds, phases, agents and health checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions import timing
from scanlake.operators import builds, joins, ranking
from scanlake.plans import bindings as b
from scanlake.plans.registry import query
from scanlake.session import staged


@query(
    "build_detail",
    "B-1",
    f"""with {b.EVENTS_SQL}
    select job, number, result, cast(building as varchar) as building, epoch_us(ts) // 1000 as timestamp_ms, duration_ms, 'MODE=' || event_type || ',SCAN_ID=scan-' || k as params,
      case event_type when 'purchase' then 1 end::bigint as artifacts from builds""",
)
def build_detail(spark, sf):
    rows = builds.build_detail(b.build_documents(spark, sf))
    shown = F.transform(F.sort_array(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(
        "job", "number", "result", F.col("building").cast("string").alias("building"), "timestamp_ms", "duration_ms",
        F.array_join(shown, ",").alias("params"),
        F.when(F.col("artifacts").isNotNull(), F.size("artifacts")).cast("bigint").alias("artifacts"),
    )


@query(
    "build_history",
    "P15 P19",
    f"""with {b.EVENTS_SQL}
    select job, number, strftime(ts, '%Y-%m-%d %H:%M:%S') as started, duration_ms // 1000 as seconds, coalesce(result, 'RUNNING') as result,
      case result when 'SUCCESS' then 'PASS' when 'UNSTABLE' then 'WARNING' when 'FAILURE' then 'FAIL' end as label from builds""",
)
def build_history(spark, sf):
    rows = builds.build_history(builds.build_detail(b.build_documents(spark, sf)))
    return rows.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


def phase_records(spark, sf):
    """Phases of a user's scans: kind = phase, ISO times with microseconds."""
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("value") * 1000000).cast("bigint"))
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    return b.events(spark, sf).select(
        F.concat(F.lit("scan-"), F.col("user_id").cast("string")).alias("scan_id"), F.col("number").alias("phase_id"), F.col("event_type").alias("name"),
        F.unix_millis("ts").alias("start_ms"), F.date_format("ts", iso).alias("started_at"), F.date_format(end, iso).alias("ended_at"),
    )


@query(
    "phase_durations",
    "P16",
    f"with {b.EVENTS_SQL} select number as phase_id, cast(trunc(trunc(value * 1000000) / 1000) as bigint) as duration_ms from builds",
)
def phase_durations(spark, sf):
    return builds.phase_durations(phase_records(spark, sf)).select("phase_id", "duration_ms")


@query(
    "age_minutes",
    "P17",
    f"with {b.EVENTS_SQL} select number, cast(floor((epoch(timestamp '2024-02-01 00:00:00') - floor(epoch(ts))) / 60) as bigint) as age from builds",
)
def age(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return b.events(spark, sf).select("number", timing.age_minutes(now, F.col("ts")).alias("age"))


@query(
    "build_status",
    "B-2 J5",
    f"""with {b.EVENTS_SQL}, r as (select 'scan-' || k as scan_id, job, max(number) as number from builds group by k, job), p as (select scan_id, arg_max(job, number) as pipeline, max(number) as number from r group by scan_id)
    select p.scan_id, p.pipeline, p.number, cast(building as varchar) as building, result, duration_ms, epoch_us(ts) // 1000 as timestamp_ms from p join builds on builds.number = p.number""",
)
def build_status(spark, sf):
    # parsed once: both sides of the join read the stored rows
    rows = staged(builds.build_detail(b.build_documents(spark, sf)).drop("artifacts", "url"), "build-rows")
    newest = rows.select(F.try_element_at("params", F.lit("SCAN_ID")).alias("scan_id"), "job", "number")
    resolved = newest.groupBy("scan_id").agg(F.max_by("job", "number").alias("pipeline"), F.max("number").alias("number"))
    return builds.build_status(resolved, rows).withColumn("building", F.col("building").cast("string"))


@query(
    "build_metrics",
    "B-3",
    f"""with {b.EVENTS_SQL} select job, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as bucket, count(*) as scans, count(*) filter (result = 'FAILURE') as failures,
      cast(sum(duration_ms) as double) / count(*) as avg_duration_ms from builds group by job, date_trunc('hour', ts)""",
)
def build_metrics(spark, sf):
    rows = builds.build_metrics(b.events(spark, sf))
    return rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


REGISTRATIONS_SQL = f"""{b.EVENTS_SQL}, regs as (
  select 'scan-' || k || '-' || user_id as base, case event_type when 'error' then '-ci-cd-pipeline' when 'signup' then '-security-scan-pipeline' when 'purchase' then '-devsecops-pipeline' else '' end as suffix,
    job as pipeline, number from builds)
"""


def registrations(spark, sf):
    kind = F.col("event_type")
    suffix = F.when(kind == "error", "-ci-cd-pipeline").when(kind == "signup", "-security-scan-pipeline").when(kind == "purchase", "-devsecops-pipeline").otherwise("")
    base = F.concat(F.lit("scan-"), "k", F.lit("-"), F.col("user_id").cast("string"))
    return b.events(spark, sf).select(
        F.concat(base, suffix).alias("scan_id"), base.alias("base"), F.col("job").alias("pipeline"), "number", F.col("number").alias("seq"), "event_type"
    )


@query(
    "register_build",
    "J6",
    f"""with {REGISTRATIONS_SQL}, exact as (select base || suffix as scan_id, max(number) as number from regs group by 1), derived as (select base as scan_id, min(number) as number from regs where suffix <> '' group by 1),
    m as (select * from exact union all select * from derived anti join exact using (scan_id))
    select m.scan_id, regs.pipeline, m.number from m join regs on regs.number = m.number""",
)
def register_build(spark, sf):
    return joins.register_builds(registrations(spark, sf))


@query(
    "resolve_build",
    "J5 J7",
    f"""with {REGISTRATIONS_SQL}, req as (select distinct base as scan_id from regs), kept as (select base || suffix as id, max(number) as number from regs where suffix <> '-devsecops-pipeline' group by 1),
    cand as (select scan_id, 0 as turn, number from req join kept on id = scan_id
      union all select scan_id, 1, number from req join kept on id = scan_id || '-security-scan-pipeline' union all select scan_id, 2, number from req join kept on id = scan_id || '-ci-cd-pipeline'
      union all select scan_id, 11 + cast(right(job, 1) as int), number from req join (select 'scan-' || k || '-' || user_id as sid, job, max(number) as number from builds where event_type = 'purchase' group by all) s on sid = scan_id),
    best as (select scan_id, min(turn) as turn, arg_min(number, turn) as number from cand group by scan_id)
    select req.scan_id, 'job-' || (user_id % 3) as pipeline, best.number, case when turn is null then 'none' when turn = 0 then 'exact' when turn < 10 then 'suffix' else 'search' end as how
    from req left join best using (scan_id) left join builds on builds.number = best.number""",
)
def resolve_build(spark, sf):
    """Purchases are not registered, so their scans are only found by their build parameter."""
    regs = registrations(spark, sf)
    known = regs.where("event_type <> 'purchase'").groupBy("scan_id").agg(F.max_by("pipeline", "number").alias("pipeline"), F.max("number").alias("number"))
    requests = regs.select(F.col("base").alias("scan_id")).distinct()
    searchable = regs.where("event_type = 'purchase'").select(
        F.col("pipeline").alias("job"), "number", F.create_map(F.lit("SCAN_ID"), F.col("base")).alias("params")
    )
    found = joins.find_build_by_param(requests, searchable)
    return joins.resolve_build(requests, known, found, ("job-0", "job-1", "job-2"))


@query(
    "find_build_by_param",
    "J7",
    f"""with {b.EVENTS_SQL}, newest as (select * from builds qualify row_number() over (partition by job order by number desc) <= 100)
    select 'scan-' || c_custkey as scan_id, job, max(number) as number from customer join newest on 'scan-' || c_custkey = 'scan-' || k group by all""",
)
def find_build(spark, sf):
    requests = b.table(spark, sf, "customer").select(F.concat(F.lit("scan-"), F.col("c_custkey").cast("string")).alias("scan_id"))
    newest = ranking.recent_builds(builds.build_detail(b.build_documents(spark, sf)), 100)
    return joins.find_build_by_param(requests, newest)


@query(
    "recent_builds",
    "W4",
    f"""with {b.EVENTS_SQL} select job, number, row_number() over (partition by job order by number desc) as rank, result from builds qualify row_number() over (partition by job order by number desc) <= 100""",
)
def recent(spark, sf):
    """More are asked for than are ever given."""
    rows = ranking.recent_builds(b.events(spark, sf), 250)
    return rows.select("job", "number", F.col("rank").cast("bigint").alias("rank"), "result")


@query(
    "phase_timeline",
    "W5 P16",
    f"""with {b.EVENTS_SQL}, p as (select 'scan-' || user_id as scan_id, number as phase_id, event_type as name, epoch_us(ts) // 1000 as start_ms, cast(trunc(trunc(value * 1000000) / 1000) as bigint) as duration_ms from builds)
    select scan_id, phase_id, name, duration_ms, row_number() over w as place, start_ms - lag(start_ms) over w as gap_ms, cast(sum(duration_ms) over (w rows unbounded preceding) as bigint) as elapsed_ms
    from p window w as (partition by scan_id order by start_ms, phase_id)""",
)
def timeline(spark, sf):
    rows = ranking.phase_timeline(builds.phase_durations(phase_records(spark, sf)), span_ms=86_400_000.0)
    return rows.select("scan_id", "phase_id", "name", "duration_ms", "place", "gap_ms", "elapsed_ms")


@query(
    "agent_counts",
    "A14",
    f"""with {b.EVENTS_SQL} select job as pool, count(*) filter (event_type not in ('error', 'click')) as online, count(*) as total, count(*) filter (event_type not in ('view', 'signup')) as busy from builds group by job""",
)
def agent_counts(spark, sf):
    """Node documents hold a bounded range of events each."""
    kind = F.col("event_type")
    node = F.struct(
        F.concat(F.lit("n"), F.col("number").cast("string")).alias("displayName"),
        F.when(kind != "click", kind == "error").alias("offline"), F.when(kind != "signup", kind == "view").alias("idle"),
        F.lit(2).alias("numExecutors"),
    )
    packed = b.events(spark, sf).groupBy(F.col("job").alias("pool"), F.floor(F.col("number") / 1000).alias("part")).agg(F.collect_list(node).alias("computer"))
    return builds.agent_counts(packed.select("pool", F.to_json(F.struct("computer")).alias("content")))


@query(
    "readiness",
    "A15",
    f"""with {b.EVENTS_SQL}, c as (select user_id as system, case event_type when 'click' then case when value < 1 then null else 200 end else 200 + cast(trunc(value) as int) % 400 end as status from builds)
    select system, cast(bool_and(coalesce(status < 500, false)) as varchar) as ready, count(*) filter (status < 500) as ok_checks from c group by system""",
)
def readiness(spark, sf):
    status = F.when(F.col("event_type") != "click", F.lit(200) + F.col("value").cast("int") % 400).when(F.col("value") >= 1, 200)
    rows = builds.readiness(b.events(spark, sf).select(F.col("user_id").alias("system"), status.alias("status")))
    return rows.withColumn("ready", F.col("ready").cast("string"))


@query(
    "stale_agents",
    "ST5",
    f"""with {b.EVENTS_SQL}, a as (select user_id, max(ts) as created from builds where event_type = 'signup' group by user_id)
    select user_id, cast(floor((epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(created))) / 60) as bigint) as age_minutes from a
    where epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(created)) > 7200""",
)
def stale(spark, sf):
    agents = b.events(spark, sf).where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("created"))
    rows = builds.stale_agents(agents, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return rows.select("user_id", "age_minutes")
