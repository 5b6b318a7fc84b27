"""Arrays to rows without computing the array twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list[str | Column], array: str | Column, item: str = "x", pos: str | None = None) -> DataFrame:
    """One row per element, after the ``keep`` columns; empty and null arrays give none.

    A plain explode makes the optimizer add a filter on the array's size further down, and a parse or a set of
    matches behind the array is then computed for the filter and again for the rows. The outer form has no
    such filter; its padding rows are dropped here by their missing position.
    """
    place = pos or "_pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())
    return rows if pos else rows.drop(place)


def each_entry(df: DataFrame, keep: list[str | Column], entries: str | Column) -> DataFrame:
    """The same for a map: columns ``k`` and ``v``."""
    rows = df.select(*keep, F.posexplode_outer(entries).alias("_pos", "k", "v"))
    return rows.where(F.col("_pos").isNotNull()).drop("_pos")


def each_struct(df: DataFrame, keep: list[str | Column], array: str | Column) -> DataFrame:
    """The same for an array of structs, whose fields become columns."""
    names = [name for name in df.select(*keep).columns]
    return each(df, keep, array, "_struct").select(*names, "_struct.*")


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """``where`` on a parsed value: a plain filter is pushed below the parse and repeats it there."""
    return each(df, ["*"], F.when(condition, F.array(F.lit(1))), "_keep").drop("_keep")
