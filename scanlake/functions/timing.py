"""Times, ages, build labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How build results are shown.
RESULT_LABELS = {"SUCCESS": "PASS", "UNSTABLE": "WARNING", "FAILURE": "FAIL"}


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def whole_seconds(ms: Column) -> Column:
    """Milliseconds to seconds, rounded down; absent reads as 0."""
    return F.floor(F.coalesce(ms, F.lit(0)) / F.lit(1000)).cast("bigint")


def running_result(result: Column) -> Column:
    return F.coalesce(F.nullif(result, F.lit("")), F.lit("RUNNING"))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps, cut toward zero."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return (micros / F.lit(1000)).cast("bigint")


def age_minutes(now: Column, created: Column) -> Column:
    return F.floor((F.unix_seconds(now) - F.unix_seconds(created)) / F.lit(60)).cast("bigint")


def result_label(result: Column) -> Column:
    expr = F.when(result == "SUCCESS", RESULT_LABELS["SUCCESS"])
    for name in ("UNSTABLE", "FAILURE"):
        expr = expr.when(result == name, RESULT_LABELS[name])
    return expr.otherwise(result)
