"""Words of Arrow text columns as flat numpy arrays, and small helpers that the operators share.

A word is a maximal run of ASCII letters, ASCII digits and all other than ASCII characters, with A-Z in lower case. On
UTF-8 bytes that is a table look-up, so one pass over a column gives the bounds of all words. The 64-bit hash of a word is
a polynomial of its bytes; prefix sums modulo 2**64 give it for all words of a column at once.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.session import shared_dir

#: Bytes of text that one numpy pass holds (about 60 bytes of arrays for each); a longer text is a pass of its own.
PASS_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of words, of words without digits, and of what stands between white space of ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
LETTERS = WORD.copy()
LETTERS[48:58] = False
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; as many as a pass needs are kept in the process, more are made for a longer text."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        known = np.empty(max(n, PASS_BYTES) + 1, np.uint64)
        known[0] = 1
        known[1:] = np.uint64(base)
        known = np.cumprod(known, dtype=np.uint64)
        _powers[base] = known[: PASS_BYTES + 1].copy() if n > PASS_BYTES else known
    return known[: n + 1]


def release() -> None:
    """Gives the system back what other operators have freed in this worker: Arrow's pool and the allocator of the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and shift twice)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hash(word: str) -> int:
    """The hash that ``words`` gives to one word."""
    found = words(pa.array([word]))
    if len(found.start) != 1:
        raise ValueError(f"{word!r} is not one word")
    return int(found.hash[0])


@dataclass
class Words:
    """start, end: byte bounds in ``data``; doc: row of the column; first: index of each row's first word, and the total."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    total: np.ndarray  # prefix sums of the polynomial, for ``prefixes``

    def prefixes(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word (of shorter words, of all their bytes)."""
        stop = np.minimum(self.start + size, self.end)
        return mix((self.total[stop] - self.total[self.start]) * _power(_INVERSE, len(self.data))[self.start] + np.uint64(size))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the bounds of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, values = column.buffers()
    offsets = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Runs:
    """Maximal runs of certain bytes: start, end in ``data``; doc: row of the column; first: index of each row's first run, and the total."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    inside: np.ndarray

    def strings(self) -> pa.Array:
        """The runs as Arrow strings."""
        ends = np.concatenate(([0], np.cumsum(self.end - self.start)))
        return pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.data[self.inside]))


def runs(column: pa.Array, table: np.ndarray, fold: bool = True) -> Runs:
    """Runs of the bytes that ``table`` marks, in lower case for A-Z if ``fold``. Characters of several bytes must be marked whole."""
    data, offsets = bytes_of(column)
    data = _FOLD[data] if fold else data
    inside = table[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after[: len(data)] = inside
    before[offsets] = False  # a run ends with its text
    after[offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Runs(data, offsets, start, end, doc, first, inside)


def words(column: pa.Array) -> Words:
    found = runs(column, WORD)
    start, end, data = found.start, found.end, bytes_of(column)[0]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((found.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data))[: len(data)], out=total[1:], dtype=np.uint64)
    hashed = mix((total[end] - total[start]) * _power(_INVERSE, len(data))[start])
    return Words(data, found.offsets, start, end, hashed, found.doc, found.first, total)


def passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a column that hold at most ``limit`` bytes each, or one row."""
    _, offsets = bytes_of(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high
        low = high


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``size`` words; a text of fewer words has one shingle of all of them."""
    n = len(found.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    count = np.diff(found.first)
    rest = np.repeat(found.first[1:], count) - np.arange(n)  # words from here to the end of the text
    for k in range(size):  # the hash of a short text is the same in a pass of its own, where n is below size
        value *= np.uint64(_BASE)
        if k < n:
            value[: n - k] += np.where(rest[: n - k] > k, found.hash[k:], np.uint64(0))
    short = count[found.doc] < size
    keep = (rest >= size) | (short & (np.arange(n) == found.first[found.doc]))
    return found.doc[keep], mix(value[keep])


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """Only the id, the text (null: empty) and the named columns, whatever else the input has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, and a lost executor costs no repetition of what came before."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_in = path
    return found


def discard(df: DataFrame) -> None:
    """Removes the folder of a staged table that nothing reads any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_in)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def importable(spark: SparkSession) -> SparkSession:
    """Python workers find this package in the folder the driver took it from, unless a path is set (on clusters: --py-files)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark
