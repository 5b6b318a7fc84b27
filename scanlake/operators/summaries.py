"""Scan summaries straight from report folders: every file is read and parsed once, by the parser of its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake import schemas
from scanlake.functions.severity import NAMED
from scanlake.operators import gates
from scanlake.operators.joins import PREFERRED_FILES, known_files
from scanlake.operators.totals import COUNTERS
from scanlake.sources.artifacts import non_empty_object
from scanlake.sources.textual import scan_summary_fields, unified_report_fields

# Files that answer for the whole scan, and the gate file.
WHOLE_SCAN_FILES = {"summary": ("scan-summary.json",), "unified": ("final-report.json",), "gate": ("gate-results.txt",)}
_LISTS = ("shellcheck", "hadolint")
_SINGLE = ("secrets", "sbom", "quality_gate", "summary", "unified", "gate")
_COUNTS = "struct<" + ",".join(f"{name}:bigint" for name in COUNTERS) + ">"


def _parsed(schema: str) -> Column:
    return F.from_json("content", schema, {"mode": "PERMISSIVE"})


def _level_counts(reports: Column) -> Column:
    """Counters of the vulnerabilities and misconfigurations of a parsed report; no row is made for a finding."""
    def raised(x: Column) -> Column:
        return F.upper(F.coalesce(x["Severity"], F.lit("")))

    levels = F.flatten(
        F.transform(
            F.coalesce(reports["Results"], F.array()),
            lambda r: F.concat(*[F.transform(F.coalesce(r[f], F.array()), raised) for f in ("Vulnerabilities", "Misconfigurations")]),
        )
    )

    def those(own: Column, wanted, name: str) -> Column:
        return F.size(F.filter(own, wanted)).cast("bigint").alias(name)

    def level(own: Column, name: str) -> Column:
        return those(own, lambda x: x == name, name.lower())

    def counts(own: Column) -> Column:
        """The named levels; all others, absent and empty ones too, are unknown, as by ``normalize_severity``."""
        return F.struct(*[level(own, name) for name in NAMED], those(own, lambda x: ~x.isin(*NAMED), "unknown"))

    # one element, so that the list of levels is made once
    return F.transform(F.array(levels), counts)[0]


def file_facts(files: DataFrame) -> DataFrame:
    """(scan_id, kind, usable, counts, n, text, doc): what the first file of each kind says; ``files`` is (scan_id, file, content).

    Files are facts of a few numbers before they are shuffled. Of two names of a kind the preferred one holds, also where its content
    cannot be read.
    """
    preferred = {**PREFERRED_FILES, **WHOLE_SCAN_FILES}
    known = known_files(files, ["scan_id", "content"], preferred).select("scan_id", "p.kind", "p.rank", "content")
    kind, zero = F.col("kind"), F.lit(0).cast("bigint")
    is_scan = ~kind.isin(*_LISTS, *_SINGLE)
    entries = F.json_array_length("content").cast("bigint")
    types = f"map<string,{_COUNTS}>"
    whole = f"struct<gate_passed:boolean,{','.join(f'{n}:bigint' for n in COUNTERS)},findings_by_type:{types},sbom_component_count:bigint,secrets_found:bigint,quality_gate:string>"

    def as_whole(fields: list[Column], own: Column) -> Column:
        """The fields of a document that answers for its scan, its types as counters."""
        return F.struct(*[own.cast(types).alias("findings_by_type") if k == len(COUNTERS) + 1 else f for k, f in enumerate(fields)]).cast(whole)

    summary, unified = F.col("summary"), F.col("unified")
    by_scan = F.transform_values(F.map_filter(summary["findings_by_scan"], lambda _, v: v["critical"].isNotNull()), lambda _, v: F.struct(*[F.coalesce(v[n], zero).alias(n) for n in COUNTERS]))
    by_tool = F.transform_values(unified["findings_by_tool"], lambda _, v: F.struct(*[F.coalesce(F.try_element_at(v, F.lit(n.upper())), zero).alias(n) for n in COUNTERS]))
    read = known.select(
        "scan_id", "kind", "rank", "content",
        F.when(is_scan | (kind == "secrets"), _parsed(schemas.SEVERITY_REPORT)).alias("report"),
        F.when(kind == "sbom", _parsed(schemas.SBOM_TYPES)).alias("sbom"),
        F.when(kind == "quality_gate", _parsed(schemas.QUALITY_GATE)).alias("quality"),
        F.when(kind == "summary", _parsed(schemas.SCAN_SUMMARY)).alias("summary"),
        F.when(kind == "unified", _parsed(schemas.UNIFIED_REPORT)).alias("unified"),
        F.when(kind == "gate", F.lit(True)).when(kind.isin(*_LISTS), F.coalesce(entries > 0, F.lit(False))).otherwise(non_empty_object("content")).alias("usable"),
    )
    secrets = F.aggregate(F.coalesce(F.col("report.Results"), F.array()), zero, lambda acc, r: acc + F.size(F.coalesce(r["Secrets"], F.array())))
    low = F.struct(*[(entries if name == "low" else zero).alias(name) for name in COUNTERS])
    # a document that is an object without components has none; one that is no object has no number
    components = F.when(F.json_object_keys("content").isNotNull(), F.coalesce(F.size("sbom.components"), F.lit(0)).cast("bigint"))
    wrapped = F.col("quality.projectStatus.status").isNotNull() | F.col("quality.projectStatus.conditions").isNotNull()
    status = F.nullif(F.upper(F.when(wrapped, F.col("quality.projectStatus.status")).otherwise(F.col("quality.status"))), F.lit(""))
    facts = read.select(
        "scan_id", "kind", "rank", "usable",
        F.when(kind.isin(*_LISTS), low).when(is_scan, _level_counts(F.col("report"))).alias("counts"),
        F.when(kind == "secrets", secrets).when(kind == "sbom", components).alias("n"),
        F.when(kind == "quality_gate", status).when(kind == "gate", F.col("content")).alias("text"),
        F.when(kind == "summary", as_whole(scan_summary_fields(summary), by_scan)).when(kind == "unified", as_whole(unified_report_fields(unified), by_tool)).alias("doc"),
    )
    best = facts.groupBy("scan_id", "kind").agg(F.min_by(F.struct("usable", "counts", "n", "text", "doc"), "rank").alias("b"))
    return best.select("scan_id", "kind", "b.*")


def report_types(facts: DataFrame) -> DataFrame:
    """(scan_id, report, counters) for each finding type of each scan, as rows; a scan may hold any number of registry images."""
    return facts.where(F.col("counts").isNotNull() & F.col("usable")).select("scan_id", F.col("kind").alias("report"), "counts.*")


def scan_summary_from_files(files: DataFrame) -> DataFrame:
    """One row per scan with any known file: source, counters, findings_by_type, secrets, sbom_component_count, quality_gate, gate_passed.

    A summary of the pipeline answers for its scan, else the report of a local scan, if it is an object with any key; else the
    scanners' own reports do. The map of types is part of the summary document, with one entry for each type.
    """
    facts = file_facts(files)
    kind, usable = F.col("kind"), F.col("usable")
    counted = F.col("counts").isNotNull() & usable

    def one(value: str, of: str, ready: Column = F.lit(True)) -> Column:
        return F.any_value(F.when((kind == of) & ready, F.col(value)), F.lit(True))

    scans = facts.groupBy("scan_id").agg(
        *[F.coalesce(F.sum(F.when(counted, F.col("counts")[name])), F.lit(0)).alias(name) for name in COUNTERS],
        F.map_from_entries(F.sort_array(F.collect_list(F.when(counted, F.struct("kind", "counts"))))).alias("types"),
        F.coalesce(one("n", "secrets", usable), F.lit(0)).alias("secrets"),
        one("n", "sbom").alias("components"),
        one("text", "quality_gate").alias("quality"),
        one("text", "gate").alias("gate_text"),
        F.coalesce(one("doc", "summary", usable), one("doc", "unified", usable)).alias("doc"),
        F.coalesce(F.max(F.when((kind == "summary") & usable, "summary")), F.max(F.when((kind == "unified") & usable, "unified")), F.lit("raw")).alias("source"),
    )
    whole = F.col("doc").isNotNull()

    def told(own: str, raw: Column) -> Column:
        return F.when(whole, F.col(f"doc.{own}")).otherwise(raw)

    return scans.select(
        "scan_id", "source", *[told(name, F.col(name)).alias(name) for name in COUNTERS],
        told("findings_by_type", F.col("types")).alias("findings_by_type"),
        told("secrets_found", F.col("secrets")).alias("secrets"),
        told("sbom_component_count", F.col("components")).alias("sbom_component_count"),
        told("quality_gate", F.col("quality")).alias("quality_gate"),
        told("gate_passed", gates.from_gate_file()).alias("gate_passed"),
    )
