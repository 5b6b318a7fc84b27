"""How the sources of a language differ in their words, by three-dimensional cube partitioning.

Terms are runs of letters (A-Z in lower case, all characters beyond ASCII included); a language keeps the terms that stand in ``least`` of
its documents. The share of a term in a group (the documents of one language and source) or in a whole language is the whole number
p = 1 + floor(SCALE * (count + smoothing) / (N + smoothing * V)), N being the group's count of kept terms and V their number.
Two things are told of each group: its distance to each other source of the language, the sum of abs(p - q) over all kept terms,
and the terms that it uses more than its language does.

The distances are computed on a cube. Groups are dealt to blocks by a hash of the source, terms to blocks by a hash of the term; a task owns the cell
(group block i, group block j, term block), i <= j. It gets a replica of the two slices, lays them out as dense arrays of
``GROUPS`` by ``TERMS`` numbers or so, and computes the part of each distance that its terms give. Parts are added along the term axis. A cell is
bounded whatever a group's or a language's share of the corpus is; a slice is sent to as many cells as there are group blocks.

Counts are summed for a few megabytes of text at a time, then in the task, then by key, so a source with a third of all rows
sends no more than others. Only blocks' numbers and the sizes of languages pass through the driver, as two maxima.

Rows: null text, lang and source are empty texts, and an empty lang or source is a group like others. Repeated rows and repeated ids count as often as
they stand. Groups without terms have distances too; a language without kept terms has distances of 0, and one with a single source has none. Ties in
value are ranked by item in the order of its UTF-8 bytes. An empty table gives an empty result. Extra columns are ignored. Very long texts are
looked at alone, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.words import LETTERS, batch, passes, runs, staged

SCALE = 1_000_000_000
#: Groups of a group block and terms of a term block, on average.
GROUPS, TERMS = 16, 4096
PASS_BYTES = 4 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("part", pa.int64())])


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return np.asarray(found.indices).astype(np.int64), found.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), for some megabytes of text at a time."""
    for rows in batches:
        for low, high in passes(rows.column("text"), PASS_BYTES):
            part = rows.slice(low, high - low)
            found = runs(part.column("text"), LETTERS)
            if not len(found.start):
                continue
            code, terms = _codes(found.strings())
            (lang, langs), (source, sources) = _codes(part.column("lang")), _codes(part.column("source"))
            group = lang * len(sources) + source
            one, n = np.unique(found.doc * len(terms) + code, return_counts=True)  # a document's term
            doc, term = np.divmod(one, len(terms))
            key, place, docs = np.unique(group[doc] * len(terms) + term, return_inverse=True, return_counts=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, n)
            group, term = np.divmod(key, len(terms))
            yield batch({"lang": langs.take(pa.array(group // len(sources))), "source": sources.take(pa.array(group % len(sources))), "term": terms.take(pa.array(term)).cast(pa.string()), "n": total, "docs": docs}, _COUNTS)


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), of ``docs`` with columns text, lang, source without nulls."""
    found = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str, smoothing: int) -> Column:
    """p of a count, exact beyond 64 bits; 0 where no term is kept."""
    return F.expr(f"case when {terms} > 0 then 1 + (cast({SCALE} as decimal(19, 0)) * ({n} + {smoothing})) div ({total} + {smoothing} * {terms}) else 0 end")


def _cell(table: pa.Table) -> pa.Table:
    """Parts of the distances between the groups of block i and those of block j, over the terms of one block.

    Rows without a term name the groups: p is there the share of an absent term. Every term the cell does not hold is absent
    from all of its groups; what those give is added in the cells of term block 0.
    """
    source, sources = _codes(table.column("source"))
    term, p, block = table.column("term"), np.asarray(table.column("p")), np.asarray(table.column("block"))
    head = np.asarray(term.is_null())
    absent, side = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    absent[source[head]], side[source[head]] = p[head], block[head]
    kept = np.asarray(table.column("terms")).max()
    code, names = _codes(term.filter(pa.array(~head)))
    dense = np.repeat(absent[:, None], len(names), axis=1)
    dense[source[~head], code] = p[~head]
    i, j, k = (table.column(c)[0].as_py() for c in ("i", "j", "k"))
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    a, b, part = [], [], []
    for g in left:
        gap = np.abs(absent[g] - absent[right])
        d = np.abs(dense[g] - dense[right]).sum(axis=1) + gap * ((kept if k == 0 else 0) - len(names))
        other = right != g
        a.append(np.full(other.sum(), g))
        b.append(right[other])
        part.append(d[other])
    a, b, part = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, part))
    if i != j:
        a, b, part = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((part, part))
    lang = table.column("lang")[0]
    return pa.Table.from_arrays([pa.array([lang.as_py()] * len(a), pa.string()), sources.take(pa.array(a)), sources.take(pa.array(b)), pa.array(part)], schema=_PARTS)


def distances(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item (another source), value. groups: lang, source, absent (share of an absent term), terms (V); cells: lang, source, term, p."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n"), F.max("terms").alias("terms")).agg(F.max("n"), F.max("terms")).first()
    across, along = -(-(sizes[0] or 1) // GROUPS), max(1, -(-(sizes[1] or 1) // TERMS))
    block = F.pmod(F.xxhash64("source"), F.lit(across)).alias("block")
    heads = groups.select("lang", "source", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(along - 1).cast("long"))).alias("k"), F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), "terms")
    rows = cells.select("lang", "source", block, F.pmod(F.xxhash64("term"), F.lit(along)).alias("k"), "term", "p", F.lit(0).cast("long").alias("terms"))  # V is told by the heads
    slices = heads.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    slices = slices.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    parts = slices.groupBy("lang", "i", "j", "k").applyInArrow(_cell, "lang string, source string, item string, part long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))


def audit(docs: DataFrame, least: int = 30, smoothing: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank (from 1 for each group and part; of terms the first ``top``)."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    found = staged(counts(plain), "terms")
    langs = found.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = staged(found.join(langs, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("terms"))
    groups = staged(
        plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(whole, "lang", "left")
        .fillna(0, ["total", "all_total", "terms"]).withColumn("absent", share("0", "total", "terms", smoothing)),
        "groups",
    )
    cells = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms", smoothing))
    pairs = distances(groups, cells.select("lang", "source", "term", "p")).withColumn("part", F.lit("pair"))
    lifts = cells.withColumn("value", F.col("p") - share("all_n", "all_total", "terms", smoothing)).where("value > 0")
    lifts = lifts.select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", order).select(names).unionByName(lifts.withColumn("rank", order).where(F.col("rank") <= top).select(names))
