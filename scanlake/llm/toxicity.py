"""Toxic passages: maximum-scoring segments of token log-odds, calibrated as extreme values.

1. Token counts of toxic and clean labelled texts, equal texts once, give log-odds under a Dirichlet prior in proportion
   to the corpus frequencies. Tokens are words and, for inflected and compound forms, their first bytes (``STEMS``).
   Tokens whose log-odds differ from zero by ``min_odds`` and by ``min_z`` standard errors keep their own score; a word takes its
   own or else that of its longest scored stem, and the words without any share one score.
2. A linear scan over a text finds all its maximal segments: those that no extension improves and that do not overlap.
3. Scores are log-likelihood ratios, so the best segment of a clean text of n tokens follows a Gumbel law with scale 1
   around ln n + mu. mu is fitted on clean texts, and a segment's excess over it is -ln of its expected number. A text's
   evidence is the sum over its significant segments, or the excess of its best one if none is. A logistic curve, fitted
   on labelled texts that the counts did not use, makes a probability of it.

Rows: texts that are null or empty, and those without a known token, have no segment; their evidence is that of score 0.
A document id that repeats is scored row by row; equal texts have equal scores. Labels that repeat count once, toxic if any
is. Label rows without document or with a null label are left out. Without labels of both classes every score is 0. A row
without an id is scored and not held out. Extra input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.words import batch, passes, texts, words

#: Labelled rows a fit reads at most, chosen by the hash of their id; 40,000 rows of 16 bytes are broadcast.
TRAIN_ROWS = 40_000

#: Lengths in bytes of the stems that count besides whole words, longest first.
STEMS = (8, 7, 6, 5)

_BIN = 0.25  # width of an evidence bin of the calibration
_LOW, _HIGH = -20.0, 60.0


@dataclass(frozen=True)
class ToxicModel:
    token: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    score: np.ndarray = field(default_factory=lambda: np.zeros(0))
    other: float = -1.0  # of every other token
    mu: float = 0.0
    slope: float = 0.0
    intercept: float = -math.inf


def fold(id_col: str = "doc_id"):
    """0 to 4; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def maximal_segments(scores: list[float], starts: list[float]) -> list[tuple[int, int, float]]:
    """All maximal segments as (first, last, score) over positive items.

    ``scores``: of each item, positive; ``starts``: sum of all scores before it, gaps included. A candidate points to the
    nearest earlier one that starts lower, so a search skips what lies between, and the scan takes linear time.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, pointer
    for i, s in enumerate(scores):
        first, low, high = i, starts[i], starts[i] + s
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, i, low, high, j))
                break
            first, _, low, _, before = kept[j]
            del kept[j:]
            j = before
    return [(f, last, high - low) for f, last, low, high, _ in kept]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("token", pa.int64()), ("level", pa.int64()), ("toxic", pa.int64()), ("n", pa.int64())])
    for rows in batches:
        toxic = np.asarray(rows.column("toxic"))
        for low, high in passes(rows.column("text")):
            found = words(rows.column("text").slice(low, high - low))
            for kind in (0, 1):
                of_kind = toxic[low:high][found.doc] == kind
                for level, hashes in enumerate((found.hash, *map(found.prefixes, STEMS))):
                    token, n = np.unique(hashes[of_kind], return_counts=True)
                    yield batch({"token": token.view(np.int64), "level": np.full(len(n), level), "toxic": np.full(len(n), kind), "n": n}, schema)


def _evidence(texts_: pa.Array, model: ToxicModel) -> tuple[np.ndarray, list[list[tuple[int, int, float]]], np.ndarray]:
    """Of each text: the evidence, the segments as (first word, last word, excess), the number of words."""
    found = words(texts_)
    count = np.diff(found.first)
    evidence = -np.log(np.maximum(count, 1)) - model.mu
    segments: list[list[tuple[int, int, float]]] = [[] for _ in range(len(count))]
    if not len(model.token) or not len(found.start):
        return evidence, segments, count
    score = np.full(len(found.start), model.other)
    for hashes in (*(found.prefixes(size) for size in reversed(STEMS)), found.hash):
        at = np.minimum(np.searchsorted(model.token, hashes), len(model.token) - 1)
        score = np.where(model.token[at] == hashes, model.score[at], score)
    total = np.concatenate(([0.0], np.cumsum(score)))
    good = np.flatnonzero(score > 0)
    bounds = np.searchsorted(good, found.first)
    for doc in np.flatnonzero(np.diff(bounds)):
        own = good[bounds[doc] : bounds[doc + 1]]
        zero = evidence[doc]
        parts = [(int(own[a] - found.first[doc]), int(own[b] - found.first[doc]), s + zero) for a, b, s in maximal_segments(score[own].tolist(), total[own].tolist())]
        segments[doc] = [p for p in parts if p[2] > 0]
        evidence[doc] = sum(p[2] for p in segments[doc]) or max(p[2] for p in parts)
    return evidence, segments, count


def _probability(evidence: np.ndarray, model: ToxicModel) -> np.ndarray:
    if not math.isfinite(model.intercept):
        return np.zeros(len(evidence))
    return 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * np.clip(evidence, _LOW, _HIGH), -40, 40)))


def _fit_curve(evidence: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of a logistic curve by Newton steps over bins, with a weak pull of the slope towards 1."""
    x = np.stack([np.ones_like(evidence), evidence])
    pull, centre = np.array([1e-3, 1.0]), np.array([0.0, 1.0])

    def loss(beta):
        z = beta @ x
        return float(good @ np.logaddexp(0, z) + bad @ np.logaddexp(0, -z) + pull @ (beta - centre) ** 2 / 2)

    beta = np.array([math.log((bad.sum() + 0.5) / (good.sum() + 0.5)), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -40, 40)))
        slope = x @ (bad - (good + bad) * p) - pull * (beta - centre)
        step = np.linalg.solve((x * ((good + bad) * p * (1 - p))) @ x.T + np.diag(pull), slope)
        size = 1.0
        while size > 1e-9 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 1e-3))


def learn(docs: DataFrame, labels: DataFrame, prior: float = 0.05, min_z: float = 4.0, min_odds: float = 1.5, train_rows: int = TRAIN_ROWS) -> ToxicModel:
    """Folds 1 to 3 give the token scores, fold 4 the calibration, fold 0 stays unseen. ``prior``: what the prior is worth, as a share of all tokens."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null").where(fold() != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").withColumn("fold", fold())
    once = rows.where("fold < 4").dropDuplicates(["text", "toxic"])
    counts = (
        once.select("text", "toxic").mapInArrow(_counted, "token long, level long, toxic long, n long")
        .groupBy("token", "level").agg(F.sum("n").alias("n"), F.sum(F.expr("if(toxic = 1, n, 0)")).alias("y"))
    )
    total = counts.where("level = 0").agg(F.sum("n"), F.sum("y")).first()
    if not total[0] or not total[1] or total[0] == total[1]:
        return ToxicModel()
    n, y = float(total[0]), float(total[1])
    worth = prior * n
    odds = counts.withColumns({"a": F.col("n") * prior, "c": F.col("n") - F.col("y")}).withColumn(
        "score", F.log((F.col("y") + F.col("a")) / (y + worth)) - F.log((F.col("c") + F.col("a")) / (n - y + worth))
    )
    # the rows kept come from at most train_rows texts; rare tokens cannot reach min_z
    own = odds.where(F.abs("score") >= min_odds).where(F.abs("score") >= min_z * F.sqrt(1 / (F.col("y") + F.col("a")) + 1 / (F.col("c") + F.col("a")))).select("token", "level", "n", "y", "score").toPandas()
    own["hash"] = own["token"].to_numpy(np.int64).view(np.uint64)
    own = own.sort_values("hash")
    whole = own[own["level"] == 0]
    rest, toxic_rest = n - whole["n"].sum(), y - whole["y"].sum()
    other = math.log((toxic_rest + 1) / (y + 1)) - math.log((rest - toxic_rest + 1) / (n - y + 1))
    model = ToxicModel(own["hash"].to_numpy(np.uint64), own["score"].to_numpy(np.float64), min(other, -1e-3))

    def binned(batches):
        schema = pa.schema([("toxic", pa.int64()), ("bin", pa.int64())])
        for part in batches:
            for low, high in passes(part.column("text")):
                evidence, _, _ = _evidence(part.column("text").slice(low, high - low), model)
                yield batch({"toxic": part.column("toxic").slice(low, high - low), "bin": np.floor((np.clip(evidence, _LOW, _HIGH) - _LOW) / _BIN).astype(np.int64)}, schema)

    bins = rows.where("fold = 4").select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(binned, "toxic long, bin long").groupBy("toxic", "bin").count().toPandas()
    value = bins["bin"].to_numpy() * _BIN + _LOW + _BIN / 2
    number, bad = bins["count"].to_numpy(float), bins["toxic"].to_numpy() == 1
    if bad.all() or not bad.any():
        return ToxicModel()
    mu = -math.log(float((number * np.exp(-value))[~bad].sum() / number[~bad].sum()))
    intercept, slope = _fit_curve(value - mu, number * ~bad, number * bad)
    return ToxicModel(model.token, model.score, model.other, mu, slope, intercept)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, n_segments, first_word and last_word (of the strongest segment), p_value."""

    def scored(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_words", pa.int64()), ("n_segments", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("p_value", pa.float64())])
        for rows in batches:
            for low, high in passes(rows.column("text")):
                part = rows.slice(low, high - low)
                evidence, segments, count = _evidence(part.column("text"), model)
                value = _probability(evidence, model)
                best = [max(s, key=lambda p: p[2], default=(None, None, None)) for s in segments]
                yield batch({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": value, "predicted": (value >= 0.5).astype(np.int32),
                    "n_words": count, "n_segments": [len(s) for s in segments], "first_word": [b[0] for b in best], "last_word": [b[1] for b in best],
                    "p_value": -np.expm1(-np.exp(-np.clip(evidence, _LOW, _HIGH))),
                }, schema)

    return texts(docs, "doc_id", "text", F.coalesce(fold() == 0, F.lit(False)).alias("held_out")).mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int, n_words long, n_segments long, first_word long, last_word long, p_value double"
    )


def segments(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, first_word, last_word (from 0), excess: every significant passage."""

    def found(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("excess", pa.float64())])
        for rows in batches:
            ids = rows.column("doc_id")
            for low, high in passes(rows.column("text")):
                _, own, _ = _evidence(rows.column("text").slice(low, high - low), model)
                flat = [(ids[low + i].as_py(), *s) for i, each in enumerate(own) for s in each]
                yield batch(dict(zip(schema.names, zip(*flat) if flat else [[]] * 4)), schema)

    return texts(docs).mapInArrow(found, "doc_id long, first_word long, last_word long, excess double")


def without_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below 0.5. Rows are tested where they lie, without a join."""
    names = docs.columns
    place = next(i for i, name in enumerate(names) if name == "text")
    schema = docs.schema

    def kept(batches):
        for rows in batches:
            mask = np.concatenate([_probability(_evidence(rows.column(place).slice(low, high - low), model)[0], model) < 0.5 for low, high in passes(rows.column(place))] or [np.zeros(0, bool)])
            yield rows.filter(pa.array(mask))

    return docs.mapInArrow(kept, schema)
