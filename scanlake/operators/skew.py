"""Window functions over keys of any size.

A plain window puts all rows of a key into one task. Here a key is cut into slices of its
ordering column, the window runs inside the slices, and only one summary row per slice is
carried across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sliced_window(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_of: Column,
    span: float,
    sums: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Running sums (this row included) and previous values per key, in ``order``.

    ``order`` must be unique within a key and agree with ``slice_of``, a number; rows whose number falls in the
    same ``span`` share a slice. ``sums`` maps output names to summed expressions, ``previous`` maps output
    names to columns. Rows without a key or an order number have no place: they stay, with null sums and previous values. The slice ends are taken from the
    windowed rows, and both sides of the join filter alike, so that one shuffle of a narrow input serves both.
    """
    sums, previous = sums or {}, previous or {}
    known = F.col("_slice").isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    sliced = df.withColumn("_slice", F.floor(slice_of / F.lit(span)).cast("bigint")).where(known)
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    up_to_here = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = sliced.select(
        "*",
        F.row_number().over(inside).alias("_n"),
        F.lead(F.lit(1)).over(inside).isNull().alias("_last"),
        *[F.sum(expr).over(up_to_here).alias(f"_in_{name}") for name, expr in sums.items()],
        *[F.lag(column).over(inside).alias(f"_lag_{name}") for name, column in previous.items()],
    )
    across = W.partitionBy(*keys).orderBy("_slice")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = rows.where("_last").select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_in_{name}").over(before), F.lit(0)).alias(f"_up_{name}") for name in sums],
        *[F.lag(column).over(across).alias(f"_up_{name}") for name, column in previous.items()],
    )
    first = F.col("_n") == 1
    placed = rows.join(carried, [*keys, "_slice"]).select(
        *df.columns,
        *[(F.col(f"_in_{name}") + F.col(f"_up_{name}")).alias(name) for name in sums],
        *[F.when(first, F.col(f"_up_{name}")).otherwise(F.col(f"_lag_{name}")).alias(name) for name in previous],
    )
    unplaced = df.where(~F.coalesce(_known(keys, slice_of), F.lit(False)))
    return placed.unionByName(unplaced, allowMissingColumns=True)


def _known(keys: list[str], slice_of: Column) -> Column:
    known = slice_of.isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    return known
