"""Personal data: formats found by pattern, and identifiers found by bootstrapped contexts.

Formats (e-mail, IP address, card, phone) are the seed entities, and so are keys: 16 to 128 characters that mix letters and
digits as made-up words do not (``is_key``). What stands around an entity are its lexical patterns: two words before it, two words
after it, one on each side, and the name that it is set equal to (``token = "_``, ``password=_``). Slots are the seed entities and every
other chunk of five characters or more that holds a digit; chunks end at blanks, brackets, quotes, signs of assignment and at the
border of a format's span. They form a bipartite graph of patterns and instances (kind of slot and text). Keys become spans of kind
``id`` as they stand, other chunks if the graph accepts them.

Spark scores the graph by turns. A pattern's confidence is the mean score of its distinct instances, shrunk by
``PRIOR`` instances of score 0, so a rare pattern is not trusted; it counts only with ``SUPPORT`` distinct seeds or found
instances or more, so a pattern of found instances only takes part from the turn on in which enough of them are accepted.
An instance's score is 1 for a seed, and otherwise one minus the product of (1 - confidence) over its patterns. Scores only
rise from turn to turn. The turns end when no instance is accepted any more and no score rises by more than ``STILL``; slots of
instances that reach ``ACCEPT`` become spans of kind ``id``.

The texts are read once. What is stored is one row of slots per document that has any; every step of the graph is an aggregate
or an equi-join on hashes, folded before it is shuffled, so a pattern that a third of the corpus shares is one row per task.

Rows: null is empty; an empty text has no spans. Equal texts have equal spans, and repeated rows count once as instances.
Rows without a doc_id are worked on like others. Spans count code points, the end exclusive. Very long texts are searched whole, in time
that is linear in their length. An empty table has no spans. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.words import batch, fresh, staged, texts

KINDS = ("email", "ip", "card", "phone", "id")
SUPPORT, PRIOR, ACCEPT, STILL = 5, 3.0, 0.5, 1e-3

# The formats are searched in time that is linear in the text: a match of an e-mail goes from the start of its run of local
# characters to an "@", and one of an IP address begins where a run of digits does, so no other start has to be tried.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DIGIT = re.compile(r"[0-9]")
_CUT = re.compile(r"[\s=:;,\"'`()\[\]{}<>|&?!]")
_WORD = re.compile(r"\w+")
_KEY = re.compile(r"[A-Za-z0-9_+-]{16,128}")
_CHANGE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_NAMED = re.compile(r"(\w+)([^\w]{1,6})$")
_EDGE = ".,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four formats: leftmost, not overlapping within a kind; matches that fail a test are dropped."""
    found = []
    at, least = text.find("@"), 0  # least: where the next match may begin
    while at >= 0:
        low = at
        while low > least and _LOCAL.match(text[low - 1]):
            low -= 1
        m = DOMAIN.match(text, at + 1) if low < at else None
        if m:
            found.append((0, low, m.end()))
        least = m.end() if m else at + 1
        at = text.find("@", at + 1)
    if _DIGIT.search(text) is None:
        return found
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def is_key(chunk: str) -> bool:
    """Whether a chunk looks drawn at random: letters and digits change three times or more, at 3 bits a character or more."""
    if not _KEY.fullmatch(chunk) or len(_CHANGE.findall(chunk)) < 3:
        return False
    counts = Counter(chunk).values()
    return sum(n * math.log2(len(chunk) / n) for n in counts) >= 3.0 * len(chunk)


def slots(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end): the spans, and as kind 4 other chunks of five characters or more that hold a digit."""
    found = list(spans)
    merged: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    merged.append([len(text), len(text)])
    k = at = 0
    while (m := _DIGIT.search(text, at)) is not None:
        low = m.start()
        while merged[k][1] <= low:
            at = max(at, merged[k][1])
            k += 1
        if merged[k][0] <= low:
            at = merged[k][1]
            continue
        stop = _CUT.search(text, low, merged[k][0])
        end = stop.start() if stop else merged[k][0]
        while low > at and not _CUT.match(text[low - 1]):
            low -= 1
        at = end
        while low < end and text[low] in _EDGE:
            low += 1
        while end > low and text[end - 1] in _EDGE:
            end -= 1
        if end - low >= 5:
            found.append((4, low, end))
    return found


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a slot, in lower case; a side without enough words gives none of its patterns.

    Words more than 80 characters away are not looked at.
    """
    left = text[_back(text, start) : start].lower()
    before = _WORD.findall(left)[-2:]
    after = _WORD.findall(text[end : end + 80].lower())[:2]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    named = _NAMED.search(left)
    if named and ("=" in named[2] or ":" in named[2]):
        out.append(f"{named[1]}{''.join(named[2].split())}_")
    return out


def _back(text: str, start: int) -> int:
    """Start of a word at most 80 characters before a slot (longer words are no part of a pattern)."""
    low = max(0, start - 80)
    return low if not low else next((k for k in range(low, start) if not text[k].isalnum()), start)


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()),
    ("slots", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]))),
])
_FOUND_DDL = "doc_id long, text_key long, slots array<struct<kind: int, start: long, end: long, text: string, seed: boolean, patterns: array<string>>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out = []
        for value in rows.column("text"):
            text = value.as_py()
            own = slots(text, base_spans(text))
            out.append([{"kind": k, "start": s, "end": e, "text": text[s:e], "seed": k < 4 or is_key(text[s:e]), "patterns": patterns(text, s, e)} for k, s, e in own])
        yield batch({"doc_id": rows.column("doc_id"), "text_key": rows.column("text_key"), "slots": out}, _FOUND)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), slots; one row per input row, stored in the shared folder."""
    rows = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return staged(rows.mapInArrow(_found, _FOUND_DDL), "slots")


def graph(found: DataFrame) -> DataFrame:
    """pattern, instance (64-bit hashes), seed: distinct edges of patterns that stand at enough distinct instances.

    Copies of a text say nothing new: edges are distinct, so a text repeated a thousand times counts once.
    """
    slot = found.select("text_key", F.explode("slots").alias("slot"))
    edges = slot.select(
        F.explode("slot.patterns").alias("words"), F.xxhash64("slot.kind", F.lower("slot.text")).alias("instance"), F.col("slot.seed").alias("seed"),
    ).select(F.xxhash64("words").alias("pattern"), "instance", "seed").distinct()
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    return staged(edges.join(enough.select("pattern"), "pattern", "left_semi"), "pattern-graph")


def bootstrap(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence, support) and (instance, score) after the last turn."""
    scores = edges.select("instance", "seed", F.col("seed").cast("double").alias("score")).distinct()
    while True:
        confidence = (
            edges.join(scores.select("instance", "score"), "instance").groupBy("pattern")
            .agg((F.sum("score") / (F.count("*") + PRIOR)).alias("confidence"), F.sum((F.col("score") >= ACCEPT).cast("long")).alias("support"))
            .where(F.col("support") >= SUPPORT)
        )
        doubt = edges.join(confidence, "pattern").groupBy("instance").agg(F.sum(F.log1p(-F.col("confidence"))).alias("doubt"))
        # the score of the turn before stays beside the new one until it is known what changed
        turn = staged(
            scores.withColumnRenamed("score", "old").join(doubt, "instance", "left")
            .selectExpr("instance", "seed", "old", "if(seed, 1D, 1 - exp(coalesce(doubt, 0D))) as score"),
            "instances",
        )
        scores = turn.select("instance", "seed", "score")
        grown, rise = turn.agg(F.count_if((F.col("score") >= ACCEPT) & (F.col("old") < ACCEPT)), F.max(F.col("score") - F.col("old"))).first()
        if not grown and (rise or 0.0) <= STILL:
            return confidence, scores.select("instance", "score")


def discovered(found: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, text_key, ids: spans (start, end) of accepted instances that are no seeds. Each row's list is bounded by its text."""
    slot = found.select("doc_id", "text_key", F.explode("slots").alias("slot")).where("not slot.seed").select(
        "doc_id", "text_key", F.xxhash64("slot.kind", F.lower("slot.text")).alias("instance"), "slot.start", "slot.end"
    )
    good = scores.where(F.col("score") >= ACCEPT).select("instance")
    return slot.join(good, "instance", "left_semi").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ids"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, spans array<struct<kind int, start, end>> by kind and start (kinds: KINDS); one row per input row."""
    found = extract(docs, id_col, text_col)
    _, scores = bootstrap(graph(found))
    extra = discovered(found, scores)
    base = found.select("doc_id", "text_key", F.expr("transform(filter(slots, s -> s.seed), s -> struct(s.kind as kind, s.start as start, s.end as end))").alias("base"))
    joined = base.join(extra.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select(
        "doc_id", "text_key",
        F.expr("array_sort(concat(base, coalesce(transform(ids, s -> struct(4 as kind, s.start as start, s.end as end)), array())))").alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, each span of the text replaced by [KIND] and ``n_chars``, if there, set anew.

    Spans that overlap are replaced as one, under the kind listed first. Texts without spans stay as they are, null included.
    """
    hashed, own, key, listed = (fresh(docs, name) for name in ("text_hash", "span_id", "span_key", "span_list"))
    spans = find(docs, id_col, text_col).where("size(spans) > 0").select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("spans").alias(listed)).dropDuplicates([own, key])
    names = docs.columns
    place = names.index(text_col)
    both = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    both = both.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(key)), "left").select(*[docs[c] for c in names], listed)

    def replaced(batches):
        for rows in batches:
            out = []
            for value, own in zip(rows.column(place), rows.column(len(names))):
                text, own = value.as_py(), own.as_py()
                out.append(blanked(text, [(s["kind"], s["start"], s["end"]) for s in own]) if own else text)
            columns = [pa.array(out, rows.schema.field(k).type) if k == place else rows.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    done = both.mapInArrow(replaced, docs.schema)
    return done.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at, merged = [], 0, []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if merged and start < merged[-1][2]:
            merged[-1] = min(kind, merged[-1][0]), merged[-1][1], max(end, merged[-1][2])
        else:
            merged.append((kind, start, end))
    for kind, start, end in merged:
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:]
