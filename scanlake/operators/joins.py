"""Lookups between scans, report files, builds and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.functions.rows import each
from scanlake.operators.totals import COUNTERS

# File names per report kind, the preferred one first.
PREFERRED_FILES = {
    "sast": ("trivy-fs-scan.json", "trivy-fs.json"),
    "sca": ("trivy-sca.json",),
    "image": ("trivy-image-scan.json", "trivy-image.json"),
    "k8s": ("trivy-k8s-scan.json", "trivy-k8s-config.json"),
    "shellcheck": ("shellcheck.json", "shellcheck-report.json"),
    "hadolint": ("hadolint.json", "hadolint-report.json"),
    "secrets": ("secret-scan.json",),
    "sbom": (
        "sbom/trivy-cyclonedx-full.json", "sbom-trivy-cyclonedx.json", "sbom/trivy-cyclonedx-sbom.json",
    ),
    "quality_gate": ("sonarqube-quality-gate.json", "sonarqube/quality-gate.json"),
}
# Families of reports with any number of files in a scan's own folder: file name's start -> report type's start.
REPORT_FAMILIES = {"registry-scan-": "registry:"}
# Pipelines, in the order a scan id is looked up in them.
PIPELINE_SUFFIXES = ("-security-scan-pipeline", "-ci-cd-pipeline", "-devsecops-pipeline")
SEARCH_ORDER = ("security-scan-pipeline", "devsecops-pipeline", "ci-cd-pipeline")



def scan_summary(scans: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per scan; each part is already one row per scan and missing parts stay null.

    All joins share the key, so every part is shuffled once and the chain keeps one partitioning.
    """
    out = scans
    for part in parts.values():
        out = out.join(part, "scan_id", "left")
    return out


def scan_totals(by_type: DataFrame) -> DataFrame:
    """Counter rows per (scan, report type) folded to one row per scan: totals, secrets and a map of the types.

    One aggregate over few rows gives all three. A scan has a handful of report types, so its map stays small;
    types that only held secrets are not in it.
    """
    counters = F.struct(*COUNTERS)
    seen = F.expr(" + ".join(COUNTERS)) > 0
    entries = F.sort_array(F.collect_list(F.when(seen, F.struct("report", counters))))
    return by_type.groupBy("scan_id").agg(
        *[F.sum(name).alias(name) for name in (*COUNTERS, "secrets")],
        F.map_from_entries(entries).alias("findings_by_type"),
    )


def report_kind(file: Column, preferred: dict[str, tuple[str, ...]] = PREFERRED_FILES) -> Column:
    """struct<kind, rank> of a file below its scan's folder, null for others.

    The table of names is a literal of a few dozen entries, so it is a lookup expression, not a join. Of a family each file is a
    kind of its own, named by what its name holds besides the family's.
    """
    pairs = [(name, kind, rank) for kind, names in preferred.items() for rank, name in enumerate(names)]
    table = F.create_map(*[x for name, kind, rank in pairs for x in (F.lit(name), F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))])
    found = F.when(file.isin(*[name for name, _, _ in pairs]), F.try_element_at(table, file))
    for start, prefix in REPORT_FAMILIES.items():
        stem = F.regexp_replace(file, r"\.json$", "")
        own = F.struct(F.concat(F.lit(prefix), F.replace(stem, F.lit(start), F.lit(""))).alias("kind"), F.lit(0).alias("rank"))
        found = found.when(file.startswith(start) & file.endswith(".json") & ~file.contains("/"), own)
    return found


def known_files(files: DataFrame, keep: list[str], preferred: dict[str, tuple[str, ...]] = PREFERRED_FILES) -> DataFrame:
    """The files with a kind, in column ``p``. A plain filter would be pushed below what makes the files, where it
    writes each name out several times over and looks it up for every row instead of every file."""
    return each(files, keep, F.filter(F.array(report_kind(F.col("file"), preferred)), lambda p: p.isNotNull()), "p")


def pick_first_present(files: DataFrame, preferred: dict[str, tuple[str, ...]] = PREFERRED_FILES) -> DataFrame:
    """(scan_id, kind, file): the first preferred name that exists, readable or not; of families every file."""
    known = known_files(files, ["scan_id", "file"], preferred)
    return known.groupBy("scan_id", F.col("p.kind").alias("kind")).agg(
        F.min_by("file", "p.rank").alias("file")
    )


def source_precedence(sources: list[DataFrame]) -> DataFrame:
    """The best source per scan, in list order. A source row with ``usable`` false is passed over."""
    ranked = [
        source.where("usable").drop("usable").withColumn("precedence", F.lit(rank))
        for rank, source in enumerate(sources)
    ]
    rows = ranked[0]
    for other in ranked[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    payload = F.struct(*[F.col(name) for name in rows.columns if name != "scan_id"])
    best = rows.groupBy("scan_id").agg(F.min_by(payload, "precedence").alias("_best"))
    return best.select("scan_id", "_best.*")


def resolve_scan_dir(requests: DataFrame, folders: DataFrame, legacy: str) -> DataFrame:
    """(requested, folder): the exact name, else the greatest folder name that starts with it, else ``legacy``.

    Exact names meet in an equi-join, whatever their length. What is left goes to the prefix search: each folder name offers
    its prefixes of the lengths still asked for. Those lengths are one array, as long as the longest request at most; an
    empty request has no prefix and answers ``legacy``.
    """
    names = folders.select(F.col("folder").alias("requested")).distinct().withColumn("exact", F.lit(True))
    asked = requests.join(names, "requested", "left")
    open_ = asked.where("exact is null and length(requested) > 0")
    lengths = open_.agg(F.array_sort(F.collect_set(F.length("requested"))).alias("lengths"))
    own = F.filter("lengths", lambda n: n < F.length("folder"))
    prefixes = (
        folders.withColumn("lengths", lengths.scalar()).select("folder", F.explode(own).alias("n"))
        .groupBy(F.left(F.col("folder"), F.col("n")).alias("requested")).agg(F.max("folder").alias("greatest"))
    )
    found = asked.join(prefixes, "requested", "left")
    folder = F.when(F.col("exact"), F.col("requested")).otherwise(F.coalesce("greatest", F.lit(legacy)))
    how = F.when(F.col("exact"), "exact").when(F.col("greatest").isNotNull(), "prefix").otherwise("legacy")
    return found.select("requested", folder.alias("folder"), how.alias("how"))


def _first_suffix(scan_id: Column) -> Column:
    base = F.lit(None).cast("string")
    for suffix in reversed(PIPELINE_SUFFIXES):
        base = F.when(
            scan_id.endswith(suffix), F.substring(scan_id, F.lit(1), F.length(scan_id) - F.lit(len(suffix)))
        ).otherwise(base)
    return base


def register_builds(registrations: DataFrame) -> DataFrame:
    """The scan-id map after all registrations (scan_id, pipeline, number, seq).

    The last registration of an id wins. Its base id (pipeline suffix dropped) is added only where it is absent,
    so the first one wins, and any registration of the base id itself replaces it.
    """
    seq = F.col("seq").cast("bigint")
    base = _first_suffix(F.col("scan_id"))
    offers = registrations.select(
        "pipeline",
        "number",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("scan_id").alias("id"), F.lit(0).alias("derived"), (-seq).alias("turn")),
                    F.when(
                        base.isNotNull(),
                        F.struct(base.alias("id"), F.lit(1).alias("derived"), seq.alias("turn")),
                    ),
                )
            )
        ).alias("o"),
    )
    return offers.groupBy(F.col("o.id").alias("scan_id")).agg(
        F.min_by(F.struct("pipeline", "number"), F.struct("o.derived", "o.turn")).alias("b")
    ).select("scan_id", "b.pipeline", "b.number")


def find_build_by_param(requests: DataFrame, builds: DataFrame, parameter: str = "SCAN_ID") -> DataFrame:
    """(scan_id, job, number): the newest build of each job whose parameter equals the scan id.

    ``builds`` has (job, number, params map); limit it first with ``recent_builds`` to search only the newest.
    """
    keyed = builds.select("job", "number", F.try_element_at("params", F.lit(parameter)).alias("scan_id"))
    newest = keyed.where("scan_id is not null").groupBy("scan_id", "job").agg(F.max("number").alias("number"))
    return requests.join(newest, "scan_id")


def resolve_build(
    requests: DataFrame, registered: DataFrame, searched: DataFrame, search_order: tuple[str, ...] = SEARCH_ORDER
) -> DataFrame:
    """(scan_id, pipeline, number, how): exact id, id plus each pipeline suffix in turn, then the build search."""
    candidates = requests.select(
        "scan_id",
        F.posexplode(F.array(F.col("scan_id"), *[F.concat("scan_id", F.lit(s)) for s in PIPELINE_SUFFIXES])).alias(
            "turn", "candidate"
        ),
    )
    known = registered.withColumnRenamed("scan_id", "candidate")
    by_id = candidates.join(known, "candidate").select("scan_id", "turn", "pipeline", "number")
    place = F.array_position(F.array(*[F.lit(p) for p in search_order]), F.col("job"))
    by_search = searched.select(
        "scan_id",
        (F.when(place > 0, place).otherwise(99) + 10).cast("int").alias("turn"),
        F.col("job").alias("pipeline"),
        "number",
    )
    best = by_id.unionByName(by_search).groupBy("scan_id").agg(
        F.min_by(F.struct("pipeline", "number", "turn"), "turn").alias("b")
    )
    turn = F.col("b.turn")
    how = F.when(turn.isNull(), "none").when(turn == 0, "exact").when(turn < 10, "suffix").otherwise("search")
    return requests.join(best, "scan_id", "left").select("scan_id", "b.pipeline", "b.number", how.alias("how"))


def trace_findings(findings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Findings with the artifact their tool wrote; ``artifacts`` is (scan_id, trace_key, artifact)."""
    keyed = findings.withColumn("trace_key", F.concat(F.lit("security:"), "tool"))
    return keyed.join(artifacts, ["scan_id", "trace_key"], "left")


def suppress(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings without the accepted ids; only an entry with a reason counts.

    The list has no size bound, so the planner picks the join by its measured size.
    """
    documented = accepted.where(F.trim("reason") != "").select("id")
    return findings.join(documented, "id", "left_anti")


def traceability(scans: DataFrame, tools: dict[str, str]) -> DataFrame:
    """(scan_id, trace_key, artifact) for the files the given tools write: tool -> path below the scan."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(f"security:{tool}").alias("trace_key"),
                F.concat("scan_id", F.lit(f"/{path}")).alias("artifact"),
            )
            for tool, path in tools.items()
        ]
    )
    return scans.select("scan_id", F.inline(pairs))


# Report kinds that each scan mode runs.
MODE_KINDS = {
    "code-only": ("trivy-fs", "trivy-config", "sbom"),
    "image-only": ("trivy-image",),
    "full": ("trivy-fs", "trivy-config", "trivy-image", "sbom"),
    "k8s-manifests": ("trivy-fs", "trivy-config", "sbom"),
}


def scan_modes(scans: DataFrame) -> DataFrame:
    """(scan_id, mode, report_kind) for the kinds that apply; an image scan needs an image."""
    kinds = F.create_map(
        *[
            part
            for mode, names in MODE_KINDS.items()
            for part in (F.lit(mode), F.array(*[F.lit(n) for n in names]))
        ]
    )
    rows = scans.select(
        "scan_id", "mode", "has_image", F.explode(F.try_element_at(kinds, F.col("mode"))).alias("report_kind")
    )
    return rows.where((F.col("report_kind") != "trivy-image") | F.col("has_image")).drop("has_image")
