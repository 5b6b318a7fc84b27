"""Token ids in binary files: one zstandard frame for each document, with a dictionary that all of them share.

A file is a sequence of lines, each ended by one line feed that belongs to no frame, so Spark's text sink can write it (it puts bytes out
as they are) to any file system, with its own commit of finished tasks:

    header   JSON: format, width (bytes of an id, little-endian), dictionary (its SHA-256), file (its number in the order)
    frames   of the documents' ids, in ascending doc_id order
    index    a frame of five arrays of 64-bit integers (doc_id, null flag, offset, length, number of ids), one entry for each document
    trailer  the index line's offset and length, 16 hexadecimal digits each

The dictionary is trained on the serialized ids of at most ``SAMPLE_ROWS`` documents, those with the smallest hash of the id, and of
each at most ``SAMPLE_IDS`` ids; it only makes files smaller, ids are exact with any. It lies beside the files and is named by its hash: files are
refused with another one. Single documents are read by the index: only the files whose range holds an id are opened, and only its frame is unpacked.

Documents are encoded once, where they lie, into frames; rows are then dealt to files by ranges of (doc_id, hash of text, row), so repeated
ids may span files, and each task writes one file of about ``FILE_BYTES`` and holds one index in memory.

Texts are cut where the tokenizer cuts them anyway, and each different unit of a pass is encoded once by the tokenizers library (see
``Encoder``). Special tokens' strings in a text are what the library makes of them.

Rows: null and empty texts have the end id only. A null doc_id comes first. Rows with the same doc_id are ordered by the hash of their text, equal rows as they
come. An empty table gives files without documents. Extra columns are ignored. A very long text is one frame.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm.words import SOLID, Runs, batch, discard, passes, runs, staged, texts
from scanlake.operators.skew import sliced_window

FORMAT = "token-ids-1"
SAMPLE_ROWS, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 2_000, 4_000, 112_640, 3
FILE_BYTES = 8 << 20
PASS_BYTES = 3 << 20
#: A Python worker forgets the units it met when they are more than so many, or they and their ids more than so many bytes.
REMEMBERED, REMEMBERED_BYTES = 500_000, 32 << 20

_WHOLE, _LETTER, _DIGIT, _REST = 0, 1, 2, 3
#: Whether a text is cut between two kinds of bytes: digits stand alone, letters and the rest in runs.
_CUT = np.array([[False] * 4, [False, False, True, True], [False, True, True, True], [False, True, True, False]]).ravel()


class Encoder:
    """Ids by a tokenizer of the tokenizers library that drops white space and cuts ASCII texts between letters, digits and the rest.

    Units are what stands between such borders. Next to an apostrophe, a character beyond ASCII, a control character or one that
    occurs in an added token nothing is cut, so contractions, combining marks and added tokens stay whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        alone = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = np.full(256, _WHOLE, np.uint8)
        kind[33:127], kind[48:58], kind[65:91], kind[97:123] = _REST, _DIGIT, _LETTER, _LETTER
        kind[[ord("'"), *(ord(c) for t in added for c in t if c.isascii() and not c.isalnum())]] = _WHOLE
        self.kind = kind
        ids = {chr(c): alone(chr(c)) for c in range(33, 127)}
        pairs = [(a, b) for a in ids for b in ids if _CUT[kind[ord(a)] * 4 + kind[ord(b)]]]
        whole, parts = alone(" a's\t\r\nÉ 9  <|x|>\f\v"), [alone(t) for t in ("a's", "É", "9", "<|x|>")]
        if whole != list(chain.from_iterable(parts)) or any(alone(a + b) != ids[a] + ids[b] for a, b in pairs) or any(len(self.units(pa.array([t])).start) > 1 for t in added):
            raise ValueError("only tokenizers that drop white space and cut between letters, digits and other characters")
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.apart = "".join(chr(c) for c in range(33, 127) if kind[c] == _WHOLE)
        self.memory = Memory()

    def units(self, column: pa.Array) -> Runs:
        found = runs(column, SOLID, fold=False)
        kind = self.kind[found.data]
        cut = _CUT[kind[:-1] * 4 + kind[1:]] & found.inside[:-1] & found.inside[1:]
        border = found.offsets[1:-1]
        cut[border[(border > 0) & (border <= len(cut))] - 1] = False  # is a border already
        at = np.flatnonzero(cut) + 1
        start, end = np.sort(np.concatenate((found.start, at))), np.sort(np.concatenate((found.end, at)))
        return replace(found, start=start, end=end, first=np.searchsorted(start, found.offsets))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's."""
        found = self.units(column)
        unit = found.strings().dictionary_encode()
        if len(self.memory.names) > REMEMBERED or self.memory.names.nbytes + self.memory.ids.nbytes > REMEMBERED_BYTES:
            self.memory = Memory()
        known = pc.index_in(unit.dictionary, value_set=self.memory.names)
        new = known.is_null()
        slots = np.asarray(known.fill_null(0)).astype(np.int64)
        slots[np.asarray(new)] = len(self.memory.names) + np.arange(known.null_count)
        self._learn(unit.dictionary.filter(new))
        slot = slots[np.asarray(unit.indices)]
        length = self.memory.length[slot]
        ends = np.concatenate(([0], np.cumsum(length)))
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.memory.start[slot], length)
        return self.memory.ids[place], ends[found.first]

    def _learn(self, units: pa.Array) -> None:
        """Ids of units that were not met before, in the order of their slots.

        Units that are one word for the tokenizer are encoded 64 at a time with blanks between them: each ends with a token that
        ends a word. Where the ends are not as many as the units, and for all other units, each is encoded by itself.
        """
        names = units.to_pylist()
        one = [k for k, n in enumerate(names) if n.isalpha() or (n.isascii() and n.isprintable() and not any(c in n for c in self.apart))] if self.ends.any() else []
        alone = set(range(len(names))) - set(one)
        order, ids, length = [], [], []
        groups = [one[k : k + 64] for k in range(0, len(one), 64)]
        for low in range(0, len(groups), 256):
            part = groups[low : low + 256]
            for group, coded in zip(part, self.tokenizer.encode_batch_fast([" ".join([names[k] for k in g]) for g in part], add_special_tokens=False)):
                own = np.array(coded.ids, np.uint32)
                cut = np.flatnonzero(self.ends[own]) + 1
                if len(cut) == len(group) and cut[-1] == len(own):
                    order.extend(group)
                    ids.append(own)
                    length.append(np.diff(cut, prepend=0))
                else:
                    alone.update(group)
        rest = sorted(alone)
        for low in range(0, len(rest), 4096):
            part = rest[low : low + 4096]
            own = [c.ids for c in self.tokenizer.encode_batch_fast([names[k] for k in part], add_special_tokens=False)]
            order.extend(part)
            ids.append(np.fromiter(chain.from_iterable(own), np.uint32))
            length.append(np.fromiter(map(len, own), np.int64, len(own)))
        if order:
            self.memory.add(units, np.array(order), np.concatenate(ids), np.concatenate(length))


class Memory:
    """The units met so far, each with a slot: start and length in one array of ids."""

    def __init__(self):
        self.names = pa.array([], pa.large_string())
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: pa.Array, order: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """``ids`` of new units lie one after the other in ``order``."""
        low = len(self.names)
        self.names = pa.concat_arrays([self.names, names])
        self.start, self.length = (np.concatenate((old, np.zeros(len(order), np.int64))) for old in (self.start, self.length))
        self.start[low + order] = len(self.ids) + np.cumsum(length) - length
        self.length[low + order] = length
        self.ids = np.concatenate((self.ids, ids))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer of a file that every executor has under this path; read once by each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _serialized(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Rows, the bytes of each one's ids with the end id, and the number of ids."""
    model = encoder(path)
    kind = np.dtype(f"<u{model.width}")
    for rows in batches:
        for low, high in passes(rows.column("text"), PASS_BYTES):
            part = rows.slice(low, high - low)
            ids, bounds = model.encode(part.column("text"))
            last = np.array([end], kind).tobytes()
            ids = ids.astype(kind)
            yield part, [ids[a:b].tobytes() + last for a, b in zip(bounds, bounds[1:])], np.diff(bounds) + 1


def train(docs: DataFrame, path: str, end: int, sample_rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes; empty if the sample is too small to train one."""
    import zstandard

    width = encoder(path).width
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["doc_id"])

    def first(batches):
        for _, coded, _ in _serialized(batches, path, end):
            yield batch({"ids": [c[: width * SAMPLE_IDS] for c in coded]}, pa.schema([("ids", pa.binary())]))

    found = rows.mapInArrow(first, "ids binary").toPandas()
    samples = [bytes(x) for x in found["ids"] if len(x) >= 8]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 10), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _zstd(dictionary: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write(docs: DataFrame, path: str, out: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Files of all documents below the new folder ``out``: ``ids/`` and ``dictionary/``. ``path``: of the tokenizer, the same on every executor."""
    import zstandard

    spark = docs.sparkSession
    docs = texts(docs, id_col, text_col)
    dictionary = train(docs, path, end)
    name, width = hashlib.sha256(dictionary).hexdigest(), encoder(path).width
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    def framed(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL, **_zstd(shared.value))
        schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("frame", pa.binary())])
        for part, coded, n in _serialized(batches, path, end):
            yield batch({"doc_id": part.column("doc_id"), "hash": part.column("hash"), "n": n, "frame": [packer.compress(c) for c in coded]}, schema)

    def lines(batches):
        at, index = 0, []

        def put(parts):
            nonlocal at
            at += sum(map(len, parts)) + len(parts)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["line"])

        yield put([json.dumps({"format": FORMAT, "width": width, "dictionary": name, "file": TaskContext.get().partitionId()}).encode()])
        for rows in batches:
            length = np.asarray(pc.binary_length(rows.column("frame"))).astype(np.int64)
            starts = at + np.cumsum(length + 1) - length - 1
            ids = rows.column("doc_id")
            index.append(np.stack([np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()).astype(np.int64), starts, length, np.asarray(rows.column("n"))]))
            yield put(rows.column("frame").to_pylist())
        where = at
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(np.concatenate(index, axis=1).astype("<i8").tobytes() if index else b"")
        yield put([packed])
        yield put([f"{where:016x}{len(packed):016x}".encode()])

    frames = staged(docs.withColumn("hash", F.xxhash64("text")).mapInArrow(framed, "doc_id long, hash long, n long, frame binary").withColumn("row", F.monotonically_increasing_id()), "frames")
    total = frames.agg(F.sum(F.length("frame") + 40)).first()[0] or 0
    dealt = frames.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    # a cast of bytes to a string keeps them, and the text sink writes them unchanged
    dealt.select("doc_id", "n", "frame").mapInArrow(lines, "line binary").select(F.col("line").cast("string").alias("value")).write.text(f"{out}/ids")
    spark.createDataFrame([(name, bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{out}/dictionary")
    discard(frames)


def _file(content: bytes) -> tuple[dict, np.ndarray]:
    """Header and index of a file."""
    import zstandard

    header = json.loads(content[: content.index(b"\n")])
    if header.get("format") != FORMAT:
        raise ValueError("not a file of token ids")
    where, size = int(content[-33:-17], 16), int(content[-17:-1], 16)
    index = np.frombuffer(zstandard.ZstdDecompressor().decompress(content[where : where + size]), "<i8")
    return header, index.reshape(5, -1)


def _dictionary(spark: SparkSession, out: str) -> tuple[str, bytes]:
    """The dictionary of a folder, of bounded size; its hash must be its name."""
    name, found = spark.read.schema("sha256 string, bytes binary").parquet(f"{out}/dictionary").first()
    if hashlib.sha256(bytes(found)).hexdigest() != name:
        raise ValueError("the dictionary is damaged")
    return name, bytes(found)


def _contents(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/ids").select("content")


def _unpacked(spark: SparkSession, out: str, schema: pa.Schema, ddl: str, row) -> DataFrame:
    """file, place (in the file), doc_id, before (ids before it in the file) and what ``row`` makes of the ids of each document."""
    import zstandard

    name, dictionary = _dictionary(spark, out)
    shared = spark.sparkContext.broadcast(dictionary)
    head = pa.schema([("file", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), *schema])

    def read(batches):
        unpacker = zstandard.ZstdDecompressor(**_zstd(shared.value))
        for rows in batches:
            for value in rows.column("content"):
                content = value.as_buffer().to_pybytes()
                header, (ids, null, offset, length, n) = _file(content)
                if header["dictionary"] != name:
                    raise ValueError("the file was written with another dictionary")
                view, kind, before = memoryview(content), np.dtype(f"<u{header['width']}"), np.cumsum(n) - n
                for low in range(0, len(ids), 4096):
                    at = range(low, min(low + 4096, len(ids)))
                    made = [row(np.frombuffer(unpacker.decompress(view[offset[k] : offset[k] + length[k]]), kind)) for k in at]
                    own = pa.array(ids[at.start : at.stop], pa.int64(), mask=null[at.start : at.stop].astype(bool))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([header["file"]] * len(at), pa.int64()), pa.array(np.arange(at.start, at.stop)), own, pa.array(before[at.start : at.stop]),
                        *[pa.array([m[c] for m in made], field.type) for c, field in enumerate(schema)],
                    ], schema=head)

    return _contents(spark, out).mapInArrow(read, f"file long, place long, doc_id long, before long, {ddl}")


def read(spark: SparkSession, out: str) -> DataFrame:
    """file, place, doc_id, before, ids (array<long>, the end id included) of all documents."""
    return _unpacked(spark, out, pa.schema([("ids", pa.list_(pa.int64()))]), "ids array<long>", lambda ids: (ids.astype(np.int64),))


def digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    rows = _unpacked(spark, out, schema, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    rows = staged(rows, "id-digests")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("all"))
    sums = sliced_window(totals, [], ["file"], F.col("file"), 4096, sums={"reached": F.col("all")})
    starts = sums.select("file", (F.col("reached") - F.col("all")).alias("first"))
    return rows.join(starts, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, out: str, wanted: list[int]) -> DataFrame:
    """doc_id, ids of the documents with the given ids: only frames of these are unpacked."""
    import zstandard

    name, dictionary = _dictionary(spark, out)
    shared, asked = spark.sparkContext.broadcast(dictionary), np.unique(np.array(wanted, np.int64))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def found(batches):
        unpacker = zstandard.ZstdDecompressor(**_zstd(shared.value))
        for rows in batches:
            for value in rows.column("content"):
                content = value.as_buffer().to_pybytes()
                header, (ids, null, offset, length, _) = _file(content)
                if header["dictionary"] != name:
                    raise ValueError("the file was written with another dictionary")
                kind = np.dtype(f"<u{header['width']}")
                for k in np.flatnonzero(np.isin(ids, asked) & (null == 0)):
                    data = unpacker.decompress(content[offset[k] : offset[k] + length[k]])
                    yield batch({"doc_id": [ids[k]], "ids": [np.frombuffer(data, kind).astype(np.int64)]}, schema)

    return _contents(spark, out).mapInArrow(found, "doc_id long, ids array<long>")
