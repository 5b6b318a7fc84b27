"""Quality by importance resampling: target over raw likelihood of hashed n-grams, sampled by Gumbel top-k.

Words and word pairs are hashed to ``BUCKETS`` buckets. Counts over the target texts and over the whole raw corpus, each
smoothed, are two bag-of-n-grams generative models. A text's log importance weight is the sum of log(target/raw) over its
n-grams; ``score`` is its mean per n-gram, so that length does not decide. Adding ``temperature`` times a Gumbel number that
derives from the row's id and text and taking the k largest keys samples k rows without replacement in proportion to
exp(score / temperature).

The k-th largest key is found exactly: three counts of 65,536 digits each over the stored keys, never a global sort.

Rows: null is empty; a text without words has score 0 and can be drawn like any other. Equal rows have equal keys; rows
that tie with the k-th largest key are all kept. Without target texts both models are the same and all scores are 0. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm.words import batch, mix, passes, staged, texts, words

BUCKETS = 10_000
#: Labelled target rows that a fit reads at most, chosen by the hash of their id; their ids (16 bytes each) are broadcast.
TARGET_ROWS = 40_000


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, bucket) of each word and each pair of neighbours."""
    found = words(column)
    pair = np.flatnonzero(found.doc[1:] == found.doc[:-1]) if len(found.doc) else np.zeros(0, np.int64)
    two = mix(found.hash[pair] * np.uint64(0xD1342543DE82EF95) + found.hash[pair + 1])
    bucket = np.concatenate((found.hash, two)) % np.uint64(BUCKETS)
    return np.concatenate((found.doc, found.doc[pair])), bucket.astype(np.int64), len(found.first) - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each task and bucket: counts are summed in the task first."""
    total = np.zeros(BUCKETS, np.int64)
    for rows in batches:
        for low, high in passes(rows.column("text")):
            total += np.bincount(ngrams(rows.column("text").slice(low, high - low))[1], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield batch({"bucket": used, "n": total[used]}, pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))


def counts(rows: DataFrame) -> np.ndarray:
    """n-grams of each bucket over all rows of ``text``."""
    found = rows.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out


def fit(raw: DataFrame, target: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """log(target/raw) of each bucket; equal target texts count once."""
    wanted = counts(target.dropDuplicates(["text"]))
    if not wanted.sum():
        return np.zeros(BUCKETS)
    there = counts(raw)
    smooth = lambda n: np.log((n + smoothing) / (n.sum() + smoothing * BUCKETS))
    return smooth(wanted) - smooth(there)


def labelled_target(docs: DataFrame, labels: DataFrame, condition: Column, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Texts of at most ``target_rows`` labelled documents that meet ``condition``."""
    ids = labels.where(condition).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return texts(docs).join(F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)), "doc_id", "left_semi")


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 7) -> DataFrame:
    """doc_id, n_grams, log_weight, score, noise (Gumbel)."""

    def weighed(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64()), ("score", pa.float64()), ("noise", pa.float64())])
        for rows in batches:
            for low, high in passes(rows.column("text")):
                part = rows.slice(low, high - low)
                doc, bucket, n = ngrams(part.column("text"))
                size = np.bincount(doc, minlength=n)
                weight = np.bincount(doc, weights=ratio[bucket], minlength=n)
                draw = (np.asarray(part.column("draw")).view(np.uint64) >> np.uint64(11)).astype(np.float64)
                yield batch({"doc_id": part.column("doc_id"), "n_grams": size, "log_weight": weight, "score": weight / np.maximum(size, 1), "noise": -np.log(-np.log((draw + 0.5) * 2.0**-53))}, schema)

    return texts(docs).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text")).mapInArrow(weighed, "doc_id long, n_grams long, log_weight double, score double, noise double")


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of a stored table with the k largest keys, ties with the last one included.

    Keys become whole numbers of 48 bits by their place between the smallest and the largest key (monotone), three counts of
    16 bits each find the cell that holds the k-th, and the last cell is settled by the keys themselves.
    """
    if k <= 0:
        return rows.where(F.lit(False))
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if n <= k:
        return rows
    cell = F.floor((F.col(key) - F.lit(low)) / F.lit(max(high - low, 1e-300)) * F.lit(float((1 << 48) - 1))).cast("long")
    placed = rows.select(key, cell.alias("cell"))
    known, left = 0, k  # the leading digits; rows still to find below all cells above them
    for shift in (32, 16, 0):
        digits = placed.where(F.shiftright("cell", shift + 16) == known).groupBy((F.shiftright("cell", shift) % 65536).alias("digit")).count().toPandas()
        digits = digits.sort_values("digit", ascending=False)
        reached = digits["count"].cumsum()
        place = int((reached < left).sum())
        left -= int(reached.iloc[place] - digits["count"].iloc[place])
        known = known * 65536 + int(digits["digit"].iloc[place])
    # rows of one 2**-48 cell: their left-th largest key by counts of distinct keys
    last = placed.where(F.col("cell") == known).groupBy(key).count().withColumn("reached", F.sum("count").over(_descending(key)))
    bound = last.where(F.col("reached") >= left).agg(F.max(key)).first()[0]
    return rows.where(F.col(key) >= F.lit(bound))


def _descending(key: str):
    from pyspark.sql import Window

    return Window.orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)


def resample(docs: DataFrame, ratio: np.ndarray, share: float, temperature: float = 0.01, seed: int = 7) -> DataFrame:
    """doc_id, n_grams, log_weight, score, key, kept: ``share`` of all rows (rounded up) are kept."""
    drawn = staged(weigh(docs, ratio, seed).withColumn("key", F.col("score") + F.col("noise") * temperature).drop("noise"), "weights")
    n = drawn.count()
    bound = top_k(drawn, "key", -int(-n * share // 1)).agg(F.min("key")).first()[0]
    return drawn.withColumn("kept", F.col("key") >= F.lit(bound) if bound is not None else F.lit(False))
