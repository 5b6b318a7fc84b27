"""Chat formatting by token-level assembly.

Each turn is <|start|> role <|message|> text <|end|>. The three marks are reserved ids behind the vocabulary; role and text
are encoded separately as ordinary text and spliced between them, so no content can become a mark. Control strings that
occur in content (the marks and those of common templates) get a backslash after their first character, one more if some are
there already; taking one away again restores every text. The loss mask of a turn is the running sum of +1 where an
assistant's text begins and -1 where it ends.

Turns are encoded where they lie; only ``read_back`` brings a conversation's turns together, and streams them in order with
one running digest per conversation, so that no conversation has to fit in memory.

Rows: null role and null text are empty; empty texts give turns without content. Turns of a conversation are ordered by turn
(null first), then role, then the SHA-256 of the text, repeated rows stay. All rows with a null conv_id are one conversation. Extra columns are
ignored. An empty table has no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Control strings of this and of common templates.
CONTROLS = (START, MESSAGE, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|user|>", "<|assistant|>", "<|system|>")

_rest = {}
for _control in CONTROLS:
    _rest.setdefault(_control[0], []).append(re.escape(_control[1:]))
_PLAIN = re.compile("|".join(rf"(?<={re.escape(c)})(?=\\*(?:{'|'.join(r)}))" for c, r in _rest.items()))
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(c)})\\(?=\\*(?:{'|'.join(r)}))" for c, r in _rest.items()))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text) if "\\" in text else text


_loaded: dict[str, object] = {}


def coder(path: str, pattern: str):
    """Byte-level BPE from a rank file that every executor has under this path; read once by each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def marks(encoding) -> dict[str, int]:
    """Reserved ids of the three marks: the first free ones."""
    return {mark: encoding.max_token_value + 1 + k for k, mark in enumerate((START, MESSAGE, END))}


def assemble(encoding, role: str, text: str) -> tuple[list[int], np.ndarray]:
    """ids and loss mask of one turn."""
    mark, head, body = marks(encoding), encoding.encode_ordinary(escape(role)), encoding.encode_ordinary(escape(text))
    ids = [mark[START], *head, mark[MESSAGE], *body, mark[END]]
    edge = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        edge[len(head) + 2] += 1
        edge[len(head) + 2 + len(body)] -= 1
    return ids, np.cumsum(edge, dtype=np.int8)[:-1]


def render(encoding, ids: list[int]) -> str:
    """The formatted text of whole turns."""
    mark, out, plain = {i: m for m, i in marks(encoding).items()}, [], []
    for i in [*ids, None]:
        if i is None or i in mark:
            out.append(encoding.decode_bytes(plain).decode())
            plain = []
            out.append(mark.get(i, ""))
        else:
            plain.append(i)
    return "".join(out)


def parse(encoding, ids: list[int], mask: list[int]) -> tuple[str, str, str]:
    """(role, text, text under the mask) of a turn, from its ids and mask alone."""
    mark = marks(encoding)
    middle, end = ids.index(mark[MESSAGE]), len(ids) - 1
    if ids[0] != mark[START] or ids[end] != mark[END]:
        raise ValueError("a turn starts and ends with its marks")
    plain = lambda part: unescape(encoding.decode_bytes(part).decode())
    return plain(ids[1:middle]), plain(ids[middle + 1 : end]), plain([i for i, m in zip(ids, mask) if m])


def format_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, tie (orders equal turns), ids array<int>, mask array<byte>: one row per turn."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8()))])

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = coder(path, pattern)
        for rows in batches:
            made = [assemble(encoding, r.as_py(), t.as_py()) for r, t in zip(rows.column("role"), rows.column("text"))]
            yield pa.RecordBatch.from_arrays([
                rows.column("conv_id"), rows.column("turn"), rows.column("role"), rows.column("tie"),
                pa.array([m[0] for m in made], schema.field("ids").type), pa.array([m[1] for m in made], schema.field("mask").type),
            ], schema=schema)

    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    # equal turns are ordered by the digest of their texts, so that whole texts need not be shuffled beside the ids
    return rows.withColumn("tie", F.sha2("text", 256)).mapInArrow(
        formatted, "conv_id long, turn long, role string, tie string, ids array<int>, mask array<byte>"
    )


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens: from ids and masks only."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens")
    kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, now, done = coder(path, pattern), None, []
        close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), *s[5:])
        for rows in batches:
            for conv, ids, mask in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2)):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(close(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, mask = ids.as_py(), mask.as_py()
                role, text, learnt = parse(encoding, ids, mask)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(learnt)
                now[4].update(learnt.encode())
                now[5] += len(render(encoding, ids))
                now[6] += len(ids)
                now[7] += sum(mask)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(close(now), kinds)], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(read, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds)))
