"""Resampling towards a target distribution: array-scored importance weights, drawn by final ranks of a radix sort.

Features are runs of 1 to ``orders`` words, joined by one space, in ``BUCKETS`` buckets by the CRC-32 of their UTF-8 bytes. Counts of
all documents and of all target texts give each bucket's gain, 1000 times the log of the smoothed target share over the smoothed
corpus share, rounded down. The gains are one array of fixed size that goes to every task with the code; a document's weight is the mean gain of
its features, rounded down. Gumbel noise that derives from the seed and the id is added, and documents of ``least`` words or more
are put in order by (score descending, doc_id, n_features) with the radix sort of ``radix``; the leading share is drawn.

Texts are read twice, once to count and once to score; what is sorted has four numbers a document.

Rows: null text has no features, weight 0, and is drawn only if ``least`` is 0. Ties go to the smaller doc_id; rows that share
doc_id and score go by fewer features first, and rows that are equal in all of these get neighbouring ranks. A null doc_id is hashed as the word null and comes
last among equal scores. Without any target text all targets count 0. An empty table gives an empty result. Extra columns are ignored.
Very long texts are passes of their own, and their words are never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.radix import ranked
from scanlake.llm.words import WORD, Runs, batch, passes, runs, staged, texts

BUCKETS = 10_000

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)

#: Bytes of a word that are taken in steps over all words at once; the rest of longer words is taken word by word.
_STEPS = 32


def _crc(before: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes, going on from the values of ``before`` (0 at first)."""
    order = np.argsort(start - end, kind="stable")  # the longest first, so that those which go on are a prefix
    at, size = start[order], (end - start)[order]
    crc = before[order] ^ np.uint32(0xFFFFFFFF)
    for k in range(min(_STEPS, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -k))  # ranges longer than k
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-size, -_STEPS))):
        crc[k] = zlib.crc32(data[at[k] + _STEPS : at[k] + size[k]], int(crc[k]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(column: pa.Array, orders: int = 1) -> tuple[np.ndarray, np.ndarray, Runs]:
    """(row, bucket) of each feature, and the words."""
    found = runs(column, WORD)
    value = _crc(np.zeros(len(found.start), np.uint32), found.data, found.start, found.end)
    docs, values = [found.doc], [value]
    blank = np.frombuffer(b" ", np.uint8)
    for n in range(1, orders):
        here = np.flatnonzero(found.doc[n:] == found.doc[:-n]) if len(found.doc) > n else np.zeros(0, np.int64)
        zero = np.zeros(len(here), np.int64)
        value = value.copy()  # of the run that begins with each word
        value[here] = _crc(_crc(value[here], blank, zero, zero + 1), found.data, found.start[here + n], found.end[here + n])
        docs.append(found.doc[here])
        values.append(value[here])
    return np.concatenate(docs), (np.concatenate(values) % np.uint32(BUCKETS)).astype(np.int64), found


def counts(rows: DataFrame, orders: int = 1) -> np.ndarray:
    """Features of each bucket over all rows of ``text``; each task sends one row for each bucket it met."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for rows in batches:
            for low, high in passes(rows.column("text")):
                total += np.bincount(features(rows.column("text").slice(low, high - low), orders)[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield batch({"bucket": used, "n": total[used]}, pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    found = rows.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(docs: DataFrame, target: DataFrame, orders: int = 1) -> np.ndarray:
    """Gain of each bucket, in thousandths of a natural logarithm."""
    s, t = counts(docs, orders).astype(np.float64), counts(target, orders).astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, orders: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for low, high in passes(rows.column("text")):
                doc, bucket, found = features(rows.column("text").slice(low, high - low), orders)
                n = np.bincount(doc, minlength=high - low)
                total = np.zeros(high - low, np.int64)
                np.add.at(total, doc, gain[bucket])
                yield batch({"doc_id": rows.column("doc_id").slice(low, high - low), "n_words": np.diff(found.first), "n_features": n, "weight": total // np.maximum(n, 1)}, schema)

    return texts(docs, id_col, text_col).mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, orders: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1 for the first; null if not drawn): one row for each of ``docs``."""
    docs, target = texts(docs), target.select(F.coalesce("text", F.lit("")).alias("text"))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    draw = (F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(draw))).cast("long")
    scored = staged(weigh(docs, gains(docs, target, orders), orders).withColumn("score", F.col("weight") + noise), "weights")
    able = F.col("n_words") >= least
    long, short = scored.where(able), scored.where(~able)
    drawn = long.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    placed = ranked(long.drop("n_words"), [("score", True), ("doc_id", False), ("n_features", False)])
    return placed.withColumn("rank", rank).drop("place").unionByName(short.drop("n_words").withColumn("rank", F.lit(None).cast("long")))
