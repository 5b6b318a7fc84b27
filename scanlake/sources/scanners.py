"""Scanner reports: one row per report file in, one row per finding out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake import schemas
from scanlake.functions.rows import each, each_struct
from scanlake.functions.severity import normalize_severity
from scanlake.functions.text import cut, ellipsis
from scanlake.sources.artifacts import parse_json

FINDING_COLUMNS = (
    "scan_id", "file", "kind", "severity", "id", "package", "installed", "fixed", "title", "target",
)


def read_vuln_reports(df: DataFrame, schema: str = schemas.VULN_REPORT) -> DataFrame:
    """Parse scanner JSON in ``content`` into ``doc``; unreadable files keep a row with a null ``doc``."""
    return parse_json(df, schema)


def _findings(reports: DataFrame, field: str) -> DataFrame:
    """Results x the given list; a missing or null list gives no rows."""
    one_result = each(reports, ["scan_id", "file"], "doc.Results", "r", "result_no")
    keep = ["scan_id", "file", "result_no", F.col("r.Target").alias("target")]
    return each(one_result, keep, f"r.{field}", "x", "finding_no")


def flatten_vulnerabilities(reports: DataFrame) -> DataFrame:
    x = F.col("x")
    return _findings(reports, "Vulnerabilities").select(
        "scan_id",
        "file",
        F.lit("vuln").alias("kind"),
        normalize_severity(x["Severity"]).alias("severity"),
        F.coalesce(x["VulnerabilityID"], F.lit("")).alias("id"),
        F.coalesce(x["PkgName"], F.lit("")).alias("package"),
        F.coalesce(x["InstalledVersion"], F.lit("")).alias("installed"),
        F.coalesce(x["FixedVersion"], F.lit("")).alias("fixed"),
        F.coalesce(ellipsis(F.coalesce(x["Title"], x["Description"]), 120), F.lit("")).alias("title"),
        F.coalesce("target", F.lit("")).alias("target"),
        "result_no",
        "finding_no",
    )


def flatten_misconfigurations(reports: DataFrame) -> DataFrame:
    x = F.col("x")
    return _findings(reports, "Misconfigurations").select(
        "scan_id",
        "file",
        F.lit("misconfig").alias("kind"),
        normalize_severity(x["Severity"]).alias("severity"),
        F.coalesce(x["ID"], F.lit("")).alias("id"),
        F.coalesce(x["Type"], F.lit("")).alias("package"),
        F.lit("").alias("installed"),
        F.coalesce(cut(x["Resolution"], 80), F.lit("")).alias("fixed"),
        F.coalesce(cut(x["Title"], 120), F.lit("")).alias("title"),
        F.coalesce("target", F.lit("")).alias("target"),
        "result_no",
        "finding_no",
    )


def flatten_secrets(reports: DataFrame) -> DataFrame:
    """A secret without a severity is HIGH."""
    x = F.col("x")
    return _findings(reports, "Secrets").select(
        "scan_id",
        "file",
        F.lit("secret").alias("kind"),
        normalize_severity(x["Severity"], default="HIGH").alias("severity"),
        F.coalesce(x["RuleID"], F.lit("")).alias("id"),
        F.coalesce(x["Category"], F.lit("")).alias("package"),
        F.lit("").alias("installed"),
        F.lit("").alias("fixed"),
        F.coalesce(x["Title"], F.lit("")).alias("title"),
        F.coalesce("target", F.lit("")).alias("target"),
        x["StartLine"].try_cast("double").try_cast("int").alias("line"),
        "result_no",
        "finding_no",
    )


def all_findings(reports: DataFrame) -> DataFrame:
    """The three kinds as one table. Each file is parsed and walked once, not once per kind."""

    def row(kind, severity, ident, package, installed, fixed, title):
        texts = {"id": ident, "package": package, "installed": installed, "fixed": fixed, "title": title}
        return F.struct(
            F.lit(kind).alias("kind"),
            severity.alias("severity"),
            *[F.coalesce(value, F.lit("")).alias(name) for name, value in texts.items()],
        )

    def vulnerability(x):
        title = ellipsis(F.coalesce(x["Title"], x["Description"]), 120)
        level = normalize_severity(x["Severity"])
        return row("vuln", level, x["VulnerabilityID"], x["PkgName"], x["InstalledVersion"], x["FixedVersion"], title)

    def misconfiguration(x):
        level = normalize_severity(x["Severity"])
        return row("misconfig", level, x["ID"], x["Type"], F.lit(""), cut(x["Resolution"], 80), cut(x["Title"], 120))

    def secret(x):
        level = normalize_severity(x["Severity"], default="HIGH")
        return row("secret", level, x["RuleID"], x["Category"], F.lit(""), F.lit(""), x["Title"])

    per_result = each(reports, ["scan_id", "file"], "doc.Results", "r")
    found = F.concat(
        *[
            F.transform(F.coalesce(F.col("r")[field], F.array()), shape)
            for field, shape in (
                ("Vulnerabilities", vulnerability), ("Misconfigurations", misconfiguration), ("Secrets", secret),
            )
        ]
    )
    target = F.coalesce("r.Target", F.lit("")).alias("target")
    return each_struct(per_result, ["scan_id", "file", target], found).select(*FINDING_COLUMNS)


def finding_counts(df: DataFrame) -> DataFrame:
    """(scan_id, file, kind, severity_raw) rows from a parse of the severity fields only, in one pass."""
    reports = parse_json(df, schemas.SEVERITY_REPORT)
    tagged = F.flatten(
        F.transform(
            F.coalesce("doc.Results", F.array()),
            lambda r: F.concat(
                F.transform(
                    F.coalesce(r["Vulnerabilities"], F.array()),
                    lambda v: F.struct(F.lit("vuln").alias("kind"), v["Severity"].alias("severity_raw")),
                ),
                F.transform(
                    F.coalesce(r["Misconfigurations"], F.array()),
                    lambda v: F.struct(F.lit("misconfig").alias("kind"), v["Severity"].alias("severity_raw")),
                ),
                F.transform(
                    F.coalesce(r["Secrets"], F.array()),
                    lambda v: F.struct(F.lit("secret").alias("kind"), v["Severity"].alias("severity_raw")),
                ),
            ),
        )
    )
    return each_struct(reports, ["scan_id", "file"], tagged)
