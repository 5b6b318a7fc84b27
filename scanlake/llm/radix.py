"""Final ranks by a distributed LSD radix sort.

The composite key is a list of whole-number columns, the last one least significant. Of each column only the span of bits that
differ between rows is kept; the spans, one after the other, are cut into digits of at most ``bits`` bits, and the rows pass
through one stable counting sort for each digit, the least significant first:

1. Rows lie at places; a run of places is a block. Each block counts its rows by digit.
2. Prefix sums over (digit, block) give the global offset of each digit of each block.
3. A row's destination is that offset plus the number of rows of its block with the same digit that lie before it.

A pass shuffles the rows once, by block and digit, so no task holds more than parts of blocks, however often a key or a digit
repeats. Counts have at most 2**bits rows for each block. Each pass is written to the shared folder and the one before it removed, so a
lost executor costs a part of one pass only.

Rows: null keys come last. Rows with equal keys get neighbouring ranks in no defined order: give keys that tell apart what shall be
told apart. An empty table stays empty. The input's columns are carried in one struct, so their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.words import discard, staged

_TOP = -(1 << 63)


def ranked(rows: DataFrame, keys: list[tuple[str, bool]], place: str = "place", bits: int = 11) -> DataFrame:
    """``rows`` and their place (long, 0 for the first); keys: (whole-number column, descending), most significant first."""
    parts = []
    for name, descending in keys:
        parts += [F.coalesce(_ordered(name, descending), F.lit(0)).alias(f"key{len(parts)}"), F.col(name).isNull().cast("long").alias(f"key{len(parts) + 1}")]
    now = staged(rows.select(F.struct(*rows.columns).alias("row"), *parts, F.monotonically_increasing_id().alias("place")), "radix")
    fields, n = _fields(now, [f"key{k + side}" for k in reversed(range(0, len(parts), 2)) for side in (0, 1)])
    if n:
        size = min(20, max(12, (n // (2 * rows.sparkSession.sparkContext.defaultParallelism)).bit_length() - 1))
        for digit in _digits(fields, bits):
            before, now = now, _pass(now, digit, size)
            discard(before)
    return now.select("row.*", F.col("place").alias(place))


def _ordered(name: str, descending: bool) -> Column:
    """A long whose bits, read without a sign, have the order of the key."""
    value = F.col(name).cast("long").bitwiseXOR(F.lit(_TOP))
    return F.bitwise_not(value) if descending else value


def _fields(rows: DataFrame, names: list[str]) -> tuple[list[tuple[Column, int, int]], int]:
    """(column, lowest bit, width) of the spans of bits that differ between rows, in the order of ``names``; number of rows."""
    n, *found = rows.agg(F.count("*"), *[F.bit_or(name).bitwiseXOR(F.bit_and(name)) for name in names]).first()
    spans = [(F.col(name), (x & -x).bit_length() - 1, (x & (1 << 64) - 1).bit_length()) for name, x in zip(names, found) if x]
    return [(field, low, high - low) for field, low, high in spans], n


def _digits(fields: list[tuple[Column, int, int]], bits: int) -> list[Column]:
    """The composite key cut into digits of even width, least significant first; a digit may hold parts of several columns.

    Rows whose keys are all equal still take one pass, which makes their places dense.
    """
    total = sum(width for _, _, width in fields)
    width = -(-total // max(1, -(-total // bits)))
    out, filled = [F.lit(0)], 0
    for field, low, size in fields:
        while size:
            if filled == width:
                out.append(F.lit(0))
                filled = 0
            take = min(size, width - filled)
            part = F.shiftrightunsigned(field, low).bitwiseAND(F.lit((1 << take) - 1))
            out[-1] = out[-1] + F.shiftleft(part, filled)
            low, size, filled = low + take, size - take, filled + take
    return out


def _pass(rows: DataFrame, digit: Column, size: int) -> DataFrame:
    spread = rows.withColumns({"block": F.shiftright("place", size), "digit": digit.cast("int")})
    counts = spread.groupBy("block", "digit").agg(F.count("*").alias("n"))
    # one row for each digit, 2**bits at most, in one task
    starts = counts.groupBy("digit").agg(F.sum("n").alias("all"))
    starts = starts.select("digit", (F.sum("all").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")).alias("start"))
    blocks = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select("block", "digit", (F.sum("n").over(blocks) - F.col("n")).alias("before")).join(starts, "digit").select("block", "digit", (F.col("start") + F.col("before")).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place"))
    placed = spread.withColumn("inside", inside).join(offsets, ["block", "digit"])
    return staged(placed.withColumn("place", F.col("offset") + F.col("inside") - 1).select(*rows.columns), "radix")
