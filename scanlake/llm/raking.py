"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). Raking scales the cells' weights to the target marginals of one
dimension after the other until all of them hold; a cell never gets more weight than it has tokens, and what it cannot take
goes to the other cells of its marginals in the next turn. A document is kept with the probability weight / tokens of its
cell, decided by the hash of its id and text, so that the expected kept tokens are the raked weights.

The corpus is read twice (sums, decisions) and only sums are shuffled, folded per task first; the turns run on the table of
cells, each as sums by the values of a dimension that are folded per task and joined to the cells: a value that many cells share is
one row per task. Documents meet their cell's probability in a join that the planner broadcasts only if the
stored table of cells is smaller than spark.sql.autoBroadcastJoinThreshold.

Targets: for each dimension the share of a value is in proportion to its tokens to the power of an exponent (1 keeps the mix,
0 makes it even), or given as a table (value, share). ``rate`` is the share of all tokens that is wanted.

Rows: null source or language is a value of its own. A null or empty text has no tokens and topic "empty"; cells without
tokens keep all their rows. Equal rows are decided alike. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm.words import discard, fresh, staged

DIMENSIONS = ("source", "lang", "topic")
RATE, TURNS, TOLERANCE = 0.85, 24, 2.5e-4
EXPONENTS = {"source": 0.85, "lang": 0.9, "topic": 0.9}


def n_tokens(text: Column) -> Column:
    """Blank-delimited chunks."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """Kind of content by form: empty, table, list, short, long or prose."""
    bars, lines = F.regexp_count(text, F.lit(r"\|")), F.regexp_count(text, F.lit(r"\n"))
    return (
        F.when(tokens == 0, "empty").when(bars * 4 > tokens, "table").when(lines * 6 > tokens, "list")
        .when(tokens < 80, "short").when(tokens > 1500, "long").otherwise("prose")
    )


def described(docs: DataFrame, seed: int = 11, keep: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic (null: empty name), n_tokens, draw (uniform, from id and text), and the column ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name("source"), name("lang"), text.alias("text"), *([keep] if keep else [])).withColumn("n_tokens", n_tokens(F.col("text")))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) * F.lit(2.0**-53)
    return rows.select("doc_id", "source", "lang", topic(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens", draw.alias("draw"), *([keep] if keep else []))


def targets(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """value, share: shares of one dimension, tempered by the exponent. They sum to 1."""
    own = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("part", F.pow("t", F.lit(exponent)))
    return own.crossJoin(F.broadcast(own.agg(F.sum("part").alias("whole")))).selectExpr("value", "part / whole as share")


def rake(cells: DataFrame, shares: dict[str, DataFrame], rate: float = RATE, turns: int = TURNS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with ``weight`` <= tokens, whose sums by dimension are share x rate x all tokens as far as tokens allow.

    Each turn is one query over the table of cells, written to the shared folder; the table of the turn before is removed. They
    end when no cell moves by more than ``tolerance`` of its weight in a turn, or after ``turns``; ``gaps`` tells what is left. Given
    shares have to sum to 1 in each dimension; values without a share get none.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = cells
    for dimension, share in shares.items():
        own = share.select(F.col("value").alias("_value"), F.col("share").alias(f"_{dimension}"))
        wanted = wanted.join(own, F.col(dimension) == F.col("_value"), "left").drop("_value").fillna(0.0, [f"_{dimension}"])
    now = staged(wanted.withColumn("weight", F.col("tokens") * F.lit(rate)), "raked")
    for _ in range(turns):
        step = now.withColumn("_last", F.col("weight"))
        for dimension in shares:
            there = step.groupBy(F.col(dimension).alias("_value")).agg(F.sum("weight").alias("_there"))
            goal = F.col("weight") * F.col(f"_{dimension}") * F.lit(rate * total) / F.col("_there")
            met = step.join(there, F.col(dimension) == F.col("_value"), "left")
            step = met.withColumn("weight", F.when(F.col("_there") > 0, F.least(F.col("tokens").cast("double"), goal)).otherwise(0.0)).drop("_value", "_there")
        step = staged(step, "raked")
        moved = step.agg(F.max(F.abs(F.col("weight") - F.col("_last")) / F.greatest(F.col("_last"), F.lit(1e-9)))).first()[0]
        discard(now)
        place, now = step.staged_in, step.drop("_last")
        now.staged_in = place
        if moved is None or moved <= tolerance:
            break
    return now.drop(*[f"_{d}" for d in shares])


def gaps(raked: DataFrame, shares: dict[str, DataFrame], rate: float = RATE) -> DataFrame:
    """dimension, value, wanted, got: what each marginal asks for and what raked cells give it.

    They differ where the turns ended first, or where cells have too few tokens for their targets.
    """
    total = float(raked.agg(F.sum("tokens")).first()[0] or 0)
    out = None
    for dimension, share in shares.items():
        got = raked.groupBy(F.col(dimension).alias("value")).agg(F.sum("weight").alias("got"))
        own = share.join(got, "value", "left").select(F.lit(dimension).alias("dimension"), "value", (F.col("share") * F.lit(rate * total)).alias("wanted"), F.coalesce("got", F.lit(0.0)).alias("got"))
        out = own if out is None else out.unionByName(own)
    return out


def chances(rows: DataFrame, rate: float = RATE, exponents: dict[str, float] | None = None) -> DataFrame:
    """Of each cell of ``described`` rows: its dimensions, tokens, weight and probability; stored in the shared folder."""
    cells = staged(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "cells")
    raked = rake(cells, {d: targets(cells, d, e) for d, e in (exponents or EXPONENTS).items()}, rate)
    return staged(raked.withColumn("probability", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)), "chances")


def mix(docs: DataFrame, rate: float = RATE, exponents: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept; one row per row of ``docs``."""
    rows = described(docs)
    chance = chances(rows, rate, exponents).select(*DIMENSIONS, "probability")
    return rows.join(chance, list(DIMENSIONS), "left").select("doc_id", *DIMENSIONS, "n_tokens", "probability", (F.col("draw") < F.col("probability")).alias("kept"))


def sampled(docs: DataFrame, rate: float = RATE, exponents: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the mix keeps."""
    chance = chances(described(docs), rate, exponents).select(F.struct(*DIMENSIONS).alias("cell"), "probability")
    row = fresh(docs, "whole_row")
    own = described(docs.select("*", F.struct(*docs.columns).alias(row)), keep=row).select(F.col(row).alias("whole"), F.struct(*DIMENSIONS).alias("cell"), "draw")
    return own.join(chance, "cell").where("draw < probability").select("whole.*")
