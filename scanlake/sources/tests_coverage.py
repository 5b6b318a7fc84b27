"""Test and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake import schemas
from scanlake.functions.numbers import one_digit, percent, rate_percent
from scanlake.functions.rows import each


def _xml(schema: str) -> Column:
    """XML text to a struct. External DOCTYPEs are ignored and malformed text gives null fields."""
    return F.from_xml(F.col("content"), schema, {"mode": "PERMISSIVE"})


def _int(col: Column) -> Column:
    return F.coalesce(col.try_cast("bigint"), F.lit(0).cast("bigint"))


#: What may hold text that looks like a tag but is none, and a whole test case (cases do not hold cases).
_HIDDEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"
_CASE = r"""(?s)(<testcase(?=[\s/>])(?:[^<>"']++|"[^"]*+"|'[^']*+')*+(?:(?<=/)>|>.*?</testcase\s*>))"""


def read_junit(df: DataFrame) -> DataFrame:
    """Counters of the root element per file, and ``cases``: its test cases at any depth, in document order.

    Cases are cut out of the text by their own tags, so no schema has to tell how deep suites nest. A file that is no well-formed XML
    has null counters and no cases.
    """
    doc = df.withColumn("doc", F.from_xml(F.col("content"), schemas.JUNIT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    whole = F.regexp_extract_all(F.regexp_replace("content", _HIDDEN, ""), F.lit(_CASE))
    parsed = F.transform(whole, lambda text: F.from_xml(text, schemas.JUNIT_CASE, {"mode": "PERMISSIVE"}))
    none = F.array().cast(f"array<struct<{schemas.JUNIT_CASE}>>")
    return doc.select(
        "scan_id",
        "file",
        _int(F.col("doc._tests")).alias("tests"),
        _int(F.col("doc._failures")).alias("failures"),
        _int(F.col("doc._errors")).alias("errors"),
        _int(F.col("doc._skipped")).alias("skipped"),
        F.col("doc._time").try_cast("double").alias("time_s"),
        F.when(F.col("doc").isNotNull() & F.col("doc._broken").isNull(), F.coalesce(parsed, none)).otherwise(none).alias("cases"),
    )


def failed_cases(junit: DataFrame) -> DataFrame:
    """One row per failure element, in document order."""
    cases = each(junit, ["scan_id", "file"], "cases", "c", "case_no")
    return each(cases, ["scan_id", "file", "case_no", "c"], "c.failure", "f").select(
        "scan_id",
        "file",
        "case_no",
        F.concat(
            F.lit("FAILED: "),
            F.coalesce("c._classname", F.lit("")),
            F.lit("."),
            F.coalesce("c._name", F.lit("")),
        ).alias("title"),
        F.substring(F.coalesce("f._message", F.lit("")), 1, 200).alias("detail"),
    )


def read_cobertura(df: DataFrame) -> DataFrame:
    doc = df.withColumn("doc", _xml(schemas.COBERTURA))
    return doc.select(
        "scan_id",
        "file",
        rate_percent(F.col("doc._line-rate")).alias("line_pct"),
        rate_percent(F.col("doc._branch-rate")).alias("branch_pct"),
        F.coalesce("doc._lines-covered", F.lit("?")).alias("lines_covered"),
        F.coalesce("doc._lines-valid", F.lit("?")).alias("lines_valid"),
        F.col("doc.packages.package").alias("packages"),
    )


def package_rates(cobertura: DataFrame) -> DataFrame:
    rows = each(cobertura, ["scan_id", "file"], "packages", "p", "pos")
    return rows.select(
        "scan_id",
        "file",
        "pos",
        F.coalesce("p._name", F.lit("unknown")).alias("package"),
        F.coalesce(rate_percent(F.col("p._line-rate")), F.lit(0.0)).alias("line_pct"),
    )


def read_jacoco(df: DataFrame, mode: str = "last") -> DataFrame:
    """LINE coverage from the counter tags, wherever they are nested and however their attributes are ordered, quoted and spaced.

    ``first``: the first counter of the file; ``last``: the last one, which is the report total;
    ``sum``: all counters added, nested levels included.
    """
    tags = F.filter(
        F.regexp_extract_all("content", F.lit(r"<counter\s[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"""\stype\s*=\s*["']LINE["']"""),
    )
    counters = F.transform(
        tags,
        lambda t: F.struct(
            _int(F.regexp_extract(t, r"""\smissed\s*=\s*["'](\d+)["']""", 1)).alias("missed"),
            _int(F.regexp_extract(t, r"""\scovered\s*=\s*["'](\d+)["']""", 1)).alias("covered"),
        ),
    )
    rows = df.select("scan_id", "file", counters.alias("counters"))
    if mode == "sum":
        zero = F.lit(0).cast("bigint")
        missed = F.aggregate("counters", zero, lambda acc, c: acc + c["missed"])
        covered = F.aggregate("counters", zero, lambda acc, c: acc + c["covered"])
    else:
        one = F.try_element_at("counters", F.lit(1 if mode == "first" else -1))
        missed, covered = one["missed"], one["covered"]
    return rows.select(
        "scan_id",
        "file",
        missed.alias("missed"),
        covered.alias("covered"),
        percent(covered, missed + covered, empty=0.0).alias("line_pct"),
    )


def read_lcov(df: DataFrame) -> DataFrame:
    """Hit over found lines of a whole file; null when nothing was found or a count is not a number."""

    def total(tag: str) -> Column:
        found = F.regexp_extract_all("content", F.lit(rf"(?m)^{tag}:(.*)$"), F.lit(1))
        # A null from a bad count makes the whole sum null.
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, n: acc + F.trim(n).try_cast("bigint"))

    rows = df.select("scan_id", "file", total("LF").alias("lines_found"), total("LH").alias("lines_hit"))
    return rows.withColumn("line_pct", percent(F.col("lines_hit"), F.col("lines_found")))


def lcov_from_lines(lines: DataFrame) -> DataFrame:
    """The same from splittable line rows (scan_id, rel_path, line), for files too large for one row."""
    tag = F.substring("line", 1, 3)
    value = F.trim(F.substring("line", 4, 2147483647)).try_cast("bigint")
    sums = lines.where(tag.isin("LF:", "LH:")).groupBy("scan_id", "rel_path").agg(
        F.sum(F.when(tag == "LF:", value)).alias("lines_found"),
        F.sum(F.when(tag == "LH:", value)).alias("lines_hit"),
        F.bool_or(value.isNull()).alias("_bad"),
    )
    pct = percent(F.col("lines_hit"), F.col("lines_found"))
    return sums.withColumn("line_pct", F.when(~F.col("_bad"), pct)).drop("_bad")


def read_istanbul(df: DataFrame) -> DataFrame:
    doc = F.from_json("content", schemas.ISTANBUL, {"mode": "PERMISSIVE"})
    return df.select("scan_id", "file", one_digit(doc["total"]["lines"]["pct"]).alias("line_pct"))


def read_go_tests(df: DataFrame) -> DataFrame:
    """NDJSON events; only pass and fail events of a named test count, bad lines are skipped."""
    event = F.from_json("line", schemas.GO_TEST_EVENT, {"mode": "PERMISSIVE"})
    rows = each(df, ["scan_id"], F.split("content", "\n"), "line").select("scan_id", event.alias("e"))
    return go_test_totals(rows.select("scan_id", "e.Action", "e.Test"))


def go_test_totals(events: DataFrame) -> DataFrame:
    named = F.coalesce(F.col("Test"), F.lit("")) != ""
    return events.groupBy("scan_id").agg(
        F.count_if((F.col("Action") == "pass") & named).alias("passed"),
        F.count_if((F.col("Action") == "fail") & named).alias("failed"),
    )


def parse_unittest_log(df: DataFrame) -> DataFrame:
    total = _int(F.regexp_extract("content", r"Ran\s+(\d+)\s+tests?", 1))
    failed = F.regexp_count("content", F.lit("FAIL:")).cast("bigint")
    errors = F.regexp_count("content", F.lit("ERROR:")).cast("bigint")
    return df.select(
        "scan_id",
        "file",
        total.alias("total"),
        failed.alias("failed"),
        errors.alias("errors"),
        F.greatest(total - failed - errors, F.lit(0)).alias("passed"),
    )
