"""Nearest neighbours by collision counting.

Vectors are scaled to length one and projected on ``PROJECTIONS`` random lines. Each projection is a sorted array. A query
looks at windows around its own projections; a row collides with it on a line if it lies in the window. Rows that collide on
``COLLISIONS`` lines or more are verified by their exact cosine. The windows widen with the search radius (virtual
rehashing: the arrays stay as they are); on each line a row at the radius or nearer lies in the window with probability 0.954,
so it collides often enough with probability 0.97.

Rows and queries are dealt to blocks of bounded size by the hash of their id; a task indexes one block of rows and answers
one block of queries on it. There are two rounds:

1. In each block the windows of a query widen until they hold k rows to verify. The k-th best over all blocks bounds how far
   the query's neighbours can be.
2. In each block the windows are set to that bound, and what they hold is verified.

So no block widens further than the best known of all blocks asks for: a query whose neighbours lie in one block leaves the others
early. A row's place in the sorted array of each line is kept, so whether it lies in a window is one comparison of whole
numbers. The answer is the best k of both rounds. Every row is indexed; nothing is fitted on data.

Rows: vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors are compared only with
those of the same number of components. Repeated ids are rows of their own, but a row with the query's id is no candidate of
it. Ties go to the smaller id; copies of a vector have equal scores. Rows without id take no part. A query with fewer than k rows
gets all of them. An empty table has no answers. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.words import staged

PROJECTIONS, COLLISIONS, HALF = 64, 58, 2.0
RADIUS, GROWTH = 0.05, 1.2
LEVELS = math.ceil(math.log(2 / RADIUS) / math.log(GROWTH)) + 1
ROW_BLOCK, QUERY_BLOCK = 8192, 4096

_FOUND = pa.schema([("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: Column) -> Column:
    big = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(big, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(big, lambda x: x != 0), F.lit(False))


def lines(size: int, seed: int) -> np.ndarray:
    """(PROJECTIONS, size) standard normal directions; the same in every task."""
    return np.random.default_rng([seed, size]).standard_normal((PROJECTIONS, size))


class Block:
    """The sorted projections of one block of rows. Vectors are in double precision and not scaled."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, seed: int = 5):
        self.rows, self.ids, self.norm = rows, ids, np.sqrt((rows * rows).sum(1))
        self.direction = lines(rows.shape[1], seed)
        placed = self.direction @ (rows / self.norm[:, None]).T
        order = np.argsort(placed, axis=1, kind="stable")
        self.places = np.empty(order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(ids), dtype=self.places.dtype)[None, :], axis=1)
        # the arrays end to end, each shifted by a step that is wider than any of them, so that one search serves all lines
        self.reach = float(np.abs(placed).max()) + 1.0
        self.shift = 2 * self.reach * np.arange(PROJECTIONS)
        self.arrays = (np.take_along_axis(placed, order, axis=1) + self.shift[:, None]).ravel()
        self.begin = len(ids) * np.arange(PROJECTIONS)

    def asked(self, query: np.ndarray) -> np.ndarray:
        return self.direction @ (query / math.sqrt(float(query @ query)))

    def within(self, asked: np.ndarray, radius: float) -> np.ndarray:
        """Rows that collide often enough in the windows of this radius."""
        edge = lambda x, side: np.searchsorted(self.arrays, np.clip(x, -self.reach, self.reach) + self.shift, side) - self.begin
        low, high = edge(asked - HALF * radius, "left"), edge(asked + HALF * radius, "right")
        kind = self.places.dtype
        inside = (self.places - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]  # places before a window wrap round
        return np.flatnonzero(inside.sum(0, dtype=np.uint8) >= COLLISIONS)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", self.rows[rows], query) / (self.norm[rows] * math.sqrt(float(np.einsum("i,i->", query, query))))

    def best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.scores(rows, query)
        if len(rows) > 4 * k:  # all that reach the k-th score, ties included
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[near], score[near]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]

    def widened(self, query: np.ndarray, query_id: int, k: int, level: int) -> tuple[np.ndarray, int]:
        """Rows in the narrowest windows that hold k of them (or in the widest), and their level.

        The search begins at a level given, the one of the query before.
        """
        asked = self.asked(query)
        look = lambda n: (lambda found: found[self.ids[found] != query_id])(self.within(asked, RADIUS * GROWTH**n))
        rows = look(level)
        while len(rows) < k and level < LEVELS:
            level += 1
            rows = look(level)
            if len(rows) >= k:
                return rows, level
        while len(rows) >= k and level > 0:
            fewer = look(level - 1)
            if len(fewer) < k:
                break
            rows, level = fewer, level - 1
        return rows, level

    def bounded(self, query: np.ndarray, query_id: int, bound: float) -> np.ndarray:
        """Rows in the windows of the radius at which the cosine is ``bound``; without a bound, all rows."""
        if math.isnan(bound):
            return np.flatnonzero(self.ids != query_id)
        found = self.within(self.asked(query), max(1e-6, math.sqrt(max(0.0, 2 - 2 * bound)) * (1 + 1e-9)))
        return found[self.ids[found] != query_id]


def _answers(table: DataFrame, asked: DataFrame, k: int, row_blocks: int, query_blocks: int) -> DataFrame:
    """query_id, row, vec_id, score: the best k of each query in each block; windows by the column ``bound``, if there is one."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = table.select("row", "id", "v", "dim", "rows_block", every(query_blocks).alias("query_block"))
    # both sides come from one table: names of their own tell their columns apart
    right = asked.select(*[F.col(c).alias(f"asked_{c}") for c in asked.columns], every(row_blocks).alias("asked_rows_block"))
    final = "bound" in asked.columns
    key = ["dim", "rows_block", "query_block"]
    asked_key = [f"asked_{c}" for c in key]

    def answered(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        cube = lambda v: v.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        number, block = rows.column("row").to_numpy(), Block(cube(rows.column("v")), rows.column("id").to_numpy())
        bounds = queries.column("asked_bound").to_numpy() if final else None
        found, level = [], 0
        for q, (query, query_id) in enumerate(zip(cube(queries.column("asked_v")), queries.column("asked_id").to_numpy())):
            if final:
                near = block.bounded(query, query_id, bounds[q])
            else:
                near, level = block.widened(query, query_id, k, level)
            near, score = block.best(near, query, k)
            found.append((np.full(len(near), query_id), number[near], block.ids[near], score))
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found), _FOUND)], schema=_FOUND)

    return left.groupBy(*key).cogroup(right.groupBy(*asked_key)).applyInArrow(answered, "query_id long, row long, vec_id long, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row that meets ``is_query`` (of id_col)."""
    good = rows.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    good = good.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"), is_query.alias("asks"))
    table = staged(good.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    total, asking = table.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    row_blocks, query_blocks = max(1, -(-total // ROW_BLOCK)), max(1, -(-(asking or 0) // QUERY_BLOCK))
    # rows of the table with repeated ids and vectors are dealt one by one, so no block grows with them
    table = table.withColumn("rows_block", F.pmod(F.xxhash64("id", "row"), F.lit(row_blocks)).cast("int"))
    # one row of each id asks, the one with the smallest vector: answers of several would share the k ranks of the id
    asked = table.where("asks").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(query_blocks)).cast("int").alias("query_block"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = staged(ranked(_answers(table, asked, k, row_blocks, query_blocks)), "neighbours")
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    asked = asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.nan)))
    second = _answers(table, asked, k, row_blocks, query_blocks)
    both = first.drop("rank").unionByName(second).dropDuplicates(["query_id", "row"])
    return ranked(both).select("query_id", "rank", "vec_id", "score")
