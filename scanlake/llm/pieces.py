"""Encoding and decoding with merge-type piece vocabularies (sentencepiece BPE with byte fallback) by a prefix table.

Every prefix of a text has one valid encoding, so it has one last token. The table holds that token for each prefix: among
the pieces that an Aho-Corasick automaton finds to end there, it is the one whose predecessor, the last token of the prefix
before it, is compatible with it: the two stay as they are when their text is encoded alone. The ids are then read backwards
from the end. Time is linear in the text, times the pieces that end at one place.

Compatibility: undo the merges of both pieces, latest first, and see whether the parts that face each other would have merged
before. Pieces of white space only share one score, so for them the pair is encoded by plain merging. Characters without a
piece stand alone and become the ids of their UTF-8 bytes.

No piece crosses the border between another character and a space, so texts are cut there, and the ids of a unit (spaces and
the characters up to the next space) are remembered in each Python worker: ``REMEMBERED`` new ones and as many before them;
units that are met again pass over to the new ones.

Rows: null is empty, and an empty text has no ids. Rows are worked on where they lie; equal texts have equal ids. Extra
columns are ignored. A model of another type, or one that cuts or rewrites texts first, is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from scanlake.llm.words import passes, release, texts

REMEMBERED = 150_000
#: Bytes of text whose units are looked at together (a longer text is looked at alone).
PASS_BYTES = 4 << 20

_SPACE = "▁"
_UNITS = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of all texts without the space that each begins with (the first one's is added), and the bounds of each text's.

    Texts with single spaces between other characters are cut by Arrow; the rest by the pattern of a unit.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    plain = pc.and_not(pc.not_equal(column, ""), pc.match_substring_regex(column, f"^ | $|  |\n$|{_SPACE}"))
    plain = np.asarray(plain.cast(pa.uint8()))
    parts, count = [], np.zeros(len(column) + 1, np.int64)
    edge = [0, *(np.flatnonzero(np.diff(plain)) + 1).tolist(), len(column)] if len(column) else []
    for low, high in zip(edge, edge[1:]):
        rows = column.slice(low, high - low)
        if plain[low]:
            cut = pc.split_pattern(rows, " ")
            count[low + 1 : high + 1] = np.asarray(pc.list_value_length(cut))
            parts.append(cut.flatten())
        else:
            names = [[u[1:] for u in _UNITS.findall(_SPACE + t.replace(" ", _SPACE))] if t else [] for t in rows.to_pylist()]
            count[low + 1 : high + 1] = [len(n) for n in names]
            parts.append(pa.array([u for n in names for u in n], pa.large_string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.large_string()), np.cumsum(count)


@dataclass
class Coded:
    """unit: place in ``table`` of each unit of all texts; bounds: of each text's units; table: ids of the different units."""

    unit: np.ndarray
    bounds: np.ndarray
    table: list[list[int]]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's."""
        size = np.fromiter(map(len, self.table), np.int64, len(self.table))
        flat = np.fromiter(chain.from_iterable(self.table), np.int32, int(size.sum()))
        length = size[self.unit]
        ends = np.concatenate(([0], np.cumsum(length)))
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], length) + np.repeat((np.cumsum(size) - size)[self.unit], length)
        return flat[place], ends[self.bounds]

    def joined(self, text: Callable[[list[int]], str]) -> list[memoryview]:
        """UTF-8 of each text's units one after the other, each as ``text`` writes its ids."""
        unit = pa.array([text(ids) for ids in self.table], pa.large_string()).take(pa.array(self.unit))
        _, ends, data = unit.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(unit) + 1] if len(unit) else np.zeros(1, np.int64)
        ends, data = ends[self.bounds].tolist(), memoryview(data) if data else memoryview(b"")
        return [data[a:b] for a, b in zip(ends, ends[1:])]


class Pieces:
    """A vocabulary with its automaton, derivations and pair tests."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(count)]
        plain = [i for i in range(count) if not (model.is_control(i) or model.is_unused(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", self.text[i]) for i in plain) or model.encode(" ①  a ", out_type=str)[:2] != [_SPACE * 2, "①"] and model.encode("  a")[:1] != [model.piece_to_id(_SPACE * 2)]:
            raise ValueError("only models that keep texts as they are, with spaces at the start of pieces")
        self.id = {self.text[i]: i for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
        self.value = {i: bytes([b]) for b, i in self.byte.items()}
        score = {i: model.get_score(i) for i in plain}
        self.score = score
        self.rank = {i: n for n, i in enumerate(sorted(plain, key=lambda i: (-score[i], i)))}
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            steps = self.merged(self.text[i])
            if [s[0] for s in steps] == [i]:  # others are never an outcome
                if len(self.text[i]) > 1:
                    self.parts[i] = steps[0][1]
                self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        self.blank = {i for i in plain if not self.text[i].strip(_SPACE)}
        self.size = [len(t) for t in self.text]
        self.plain = [t.replace(_SPACE, " ") if i in self.rank else "" for i, t in enumerate(self.text)]
        self.characters = {t for t in self.id if len(t) == 1}
        self.tested: dict[int, bool] = {}
        self.tested_before: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[tuple[int | None, tuple[int, int] | None]]:
        """Plain merging, best score first, then leftmost: (id, the two ids of the last merge) of what remains. For short texts."""
        now = [(self.id.get(c), None, c) for c in text]
        while True:
            best = None
            for k in range(len(now) - 1):
                i = self.id.get(now[k][2] + now[k + 1][2])
                if i is not None and now[k][0] is not None and now[k + 1][0] is not None and (best is None or self.score[i] > self.score[best[1]]):
                    best = k, i
            if best is None:
                return [(i, parts) for i, parts, _ in now]
            k, i = best
            now[k : k + 2] = [(i, (now[k][0], now[k + 1][0]), self.text[i])]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.tested) > REMEMBERED:
            self.tested, self.tested_before = {}, self.tested
        apart = self.tested_before.get(a << 20 | b)
        if apart is None:
            apart = self._stay_apart(a, b)
        self.tested[a << 20 | b] = apart
        return apart

    def _stay_apart(self, a: int, b: int) -> bool:
        if a in self.blank or b in self.blank:
            return [i for i, _ in self.merged(self.text[a] + self.text[b])] == [a, b]
        until = len(self.rank)  # rank of the merge that takes one of the two away; all ranks at first
        while True:
            whole = self.id.get(self.text[a] + self.text[b])
            if whole is not None and self.rank[whole] < until:
                return False
            undo_a = self.rank[a] if a in self.parts else -1
            undo_b = self.rank[b] if b in self.parts else -1
            if undo_a < 0 and undo_b < 0:
                return True
            if undo_a > undo_b:
                until, a = undo_a, self.parts[a][1]
            else:  # of two merges to the same piece the left one comes first
                until, b = undo_b + 1, self.parts[b][0]

    def _run(self, text: str, out: list[int]) -> None:
        """Ids of characters that all have pieces."""
        last, tested = [-1] * (len(text) + 1), self.tested
        for end, (i, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                if size < end:
                    before = last[end - size]
                    if before < 0:
                        continue
                    apart = tested.get(before << 20 | i)
                    if not (self.compatible(before, i) if apart is None else apart):
                        continue
                last[end] = i
        at, found, size_of = len(text), [], self.size
        while at:
            i = last[at]
            found.append(i)
            at -= size_of[i]
        out.extend(reversed(found))

    def unit(self, text: str) -> list[int]:
        out: list[int] = []
        if self.characters.issuperset(text):
            self._run(text, out)
            return out
        low = 0
        for k, c in enumerate(text):
            if c not in self.id:
                if low < k:
                    self._run(text[low:k], out)
                out.extend(self.byte[b] for b in c.encode())
                low = k + 1
        if low < len(text):
            self._run(text[low:], out)
        return out

    def forget(self) -> None:
        self.known, self.older, self.tested, self.tested_before = {}, {}, {}, {}

    def coded(self, column: pa.Array) -> Coded:
        """The units of all texts of a column; each different unit is encoded once."""
        unit, bounds = split(column)
        found = unit.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        out, known = [], self.known
        for name in found.dictionary.to_pylist():
            ids = known.get(name)
            if ids is None:
                ids = self.older.get(name)
                if ids is None:
                    ids = self.unit(_SPACE + name)
                if len(name) <= 64:
                    known[name] = ids
            out.append(ids)
        return Coded(np.asarray(found.indices), bounds, out)

    def encode(self, text: str) -> list[int]:
        ids, _ = self.coded(pa.array([text], pa.string())).ids()
        return ids.tolist()

    def _decoded(self, ids: list[int]) -> str:
        if self.value.keys().isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        out, raw = [], b""
        for i in ids:
            if i in self.value:
                raw += self.value[i]
                continue
            if raw:
                out.append(_text(raw))
                raw = b""
            out.append(self.text[i] if i in self.rank else "")
        return ("".join(out) + _text(raw)).replace(_SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the one space that encoding adds in front goes. Bytes that are no UTF-8 become U+FFFD each."""
        text = self._decoded(ids)
        return text[1:] if text.startswith(" ") else text


def _text(raw: bytes) -> str:
    """Bytes as text; each byte that is not part of a whole character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            k += size
        return "".join(out)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary of a model file that every executor has under this path; read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = pieces(path)
        for rows in batches:
            for low, high in passes(rows.column("text"), PASS_BYTES):
                part = rows.slice(low, high - low)
                ids, bounds = model.coded(part.column("text")).ids()
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])
        model.forget()  # the worker goes on with other operators

    return texts(docs, id_col, text_col).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text; null ids give an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.decode(ids.as_py() or []) for ids in part.column(1)], pa.string())], names=["doc_id", "text"])

    return rows.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({ids_col} as array<int>) as ids").mapInArrow(decoded, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with commas), decoded_sha256 (of what the ids decode to)."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for rows in batches:
            for low, high in passes(rows.column("text"), PASS_BYTES):
                part = rows.slice(low, high - low)
                coded = model.coded(part.column("text"))
                _, bounds = coded.ids()
                numbers = coded.joined(lambda ids: ",".join(map(str, ids)) + ",")
                plain = coded.joined(model._decoded)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(bounds)), pa.array([sha(t[:-1]) for t in numbers]), pa.array([sha(t[1:] if t[:1] == b" " else t) for t in plain]),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        model.forget()

    return texts(docs, id_col, text_col).mapInArrow(digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
