"""Near duplicates: ProbMinHash signatures of weighted word shingles, banding, exact verification, components.

A text is its multiset of five-word shingles. For each distinct shingle of weight w a Poisson process of rate w deals
arrivals to the ``SIZE`` registers; a register keeps the shingle of its first arrival. All arrivals derive from the
shingle's hash, so the share of equal registers of two texts estimates their probability Jaccard similarity

    J = sum over common d of 1 / sum over d' of max(a(d') / a(d), b(d') / b(d)),

which is the plain Jaccard similarity where no shingle repeats. A process ends as soon as its next arrival is later than
the text's latest register (early termination): beyond one arrival per shingle a text costs about SIZE ln SIZE arrivals.

1. Texts with the same words are one node, so copies are never paired.
2. ``BANDS`` bands of four registers make buckets. A bucket is dealt out to small circles by the hash of id and bucket; the
   pairs within a circle are candidates. A small bucket is one circle, and a member of large buckets meets others in each band.
3. Candidate pairs that the bounds of step 4 do not rule out are verified exactly on their texts. Of pairs that met in larger
   buckets only, those whose estimate is below ``threshold - SLACK`` are left to step 4.
4. Components of verified pairs. The members of large buckets that still hold several components are joined exactly. J is at
   most the share of either text's weight that the two have in common, so with J >= threshold any shingles that make up more
   than 1 - threshold of a text hold a common one. Each text is looked up by such a prefix of its rarest shingles; pairs of
   different components that share one go to step 3, unless too many shingles are in one of them only. Each term of J is at
   most max(a(d), b(d)) / M, M the sum of all such maxima, so J <= 1 - U / M with U the weight in one text only; and as the
   share in common is at least J, M <= |a| + |b| - threshold * min(|a|, |b|) where J >= threshold. U is at least the number of
   bits in which the odd sketches of both differ: the parities of the number of distinct shingles in 64 x ``PARITIES`` cells.
   Where no shingle of either repeats, the bounds of the Jaccard similarity and what follows the shared shingle count too.
   What is connected, most of a group of copies, is not paired again, and a text whose own rare shingles outweigh the prefix
   meets nobody.

Rows: texts without words are nodes by their exact text; texts of fewer than five words have one shingle of all words.
A null text is empty. Rows that share a doc_id count as one document. Rows without doc_id get a null class. Ties go to the
smallest doc_id. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.words import batch, fresh, mix, passes, shingles, staged, texts, words

SHINGLE, THRESHOLD = 5, 0.8
SIZE, ROWS = 96, 4
BANDS = SIZE // ROWS
#: Three standard errors of the estimate at the threshold.
SLACK = 0.12
#: Mean number of members of a circle; buckets of so many or fewer are one circle.
CIRCLE = 3
#: Words of 64 bits of an odd sketch.
PARITIES = 16
#: Numbers that ids are reduced to for dropping texts before the shuffle: a broadcast of at most so many whole numbers.
REDUCED = 1 << 20

_STEP = np.uint64(0xA0761D6478BD642F)
_SKETCH = "doc_id long, k1 long, k2 long, n_words long, signature array<int>, total long, plain boolean, odd array<long>"


def elements(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their weights, sorted by text and shingle."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, texts_: int, size: int = SIZE) -> np.ndarray:
    """(texts, size) registers: low 32 bits of the shingle that arrives first; 0 for texts without shingles."""
    first, kept = np.full(texts_ * size, np.inf), np.zeros(texts_ * size, np.uint64)
    last = np.full(texts_, np.inf)
    state, time = value.copy(), np.zeros(len(value))
    while len(state):
        state = mix(state + _STEP)
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        alive = time < last[doc]
        doc, value, weight, state, time = doc[alive], value[alive], weight[alive], state[alive], time[alive]
        place = doc * size + ((mix(state ^ _STEP) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        kept[place[won]] = value[won]
        last = first.reshape(texts_, size).max(axis=1)
    return (kept & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).reshape(texts_, size)


def odd_sketches(doc: np.ndarray, value: np.ndarray, texts_: int) -> np.ndarray:
    """(texts, PARITIES) words of 64 bits: whether the number of distinct shingles in a cell (the hash's low bits) is odd."""
    cell = value & np.uint64(64 * PARITIES - 1)
    bits = np.zeros(texts_ * PARITIES, np.uint64)
    np.bitwise_xor.at(bits, doc * PARITIES + (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return bits.view(np.int64).reshape(texts_, PARITIES)


def possible(threshold: float, sets: str = "true") -> str:
    """SQL: the odd sketches do not rule out that a and b reach the threshold; ``sets`` is asked too where no shingle repeats."""
    differ = " + ".join(f"bit_count(a_odd[{k}] ^ b_odd[{k}])" for k in range(PARITIES))
    sets = f"{sets} and {differ} <= {(1 - threshold) / (1 + threshold)} * (a_total + b_total) + 1e-6"
    weighted = f"{differ} <= {1 - threshold} * (a_total + b_total - {threshold} * least(a_total, b_total)) + 1e-6"
    return f"if(a_plain and b_plain, {sets}, {weighted})"


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J of two (sorted shingles, weights)."""
    (va, wa), (vb, wb) = a, b
    if not len(va) or not len(vb):
        return float(len(va) == len(vb))
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(ia) / (len(va) + len(vb) - len(ia))
    # with a(d')/b(d') above a(d)/b(d) the first quotient is the larger one, else the second
    ra, rb = wa[ia].astype(float), wb[ib].astype(float)
    ratio, order = ra / rb, np.argsort(ra / rb, kind="stable")
    only_a, only_b = wa.sum() - ra.sum(), wb.sum() - rb.sum()
    above = np.append(np.cumsum(ra[order][::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(rb[order]))
    cut = np.searchsorted(ratio[order], ratio, side="right")
    return float((1 / ((above[cut] + only_a) / ra + (below[cut] + only_b) / rb)).sum())


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("signature", pa.list_(pa.int32())), ("total", pa.int64()), ("plain", pa.bool_()), ("odd", pa.list_(pa.int64()))])
    for rows in batches:
        for low, high in passes(rows.column("text")):
            part = rows.slice(low, high - low)
            found = words(part.column("text"))
            n = np.diff(found.first)
            doc, value, weight = elements(*shingles(found, SHINGLE))
            registers, odd = signatures(doc, value, weight, high - low), odd_sketches(doc, value, high - low)
            whole = np.bincount(doc, weights=weight, minlength=high - low).astype(np.int64)
            plain = whole == np.bincount(doc, minlength=high - low)
            # two sums over (word, place) name the sequence of words; texts without words are named by their own hash
            place = np.arange(len(found.doc), dtype=np.uint64) - found.first[found.doc].astype(np.uint64)
            keys = []
            for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                value = mix(mix(place + np.uint64(salt)) ^ (found.hash + np.uint64(salt)))
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
                keys.append(np.where(n > 0, (total[found.first[1:]] - total[found.first[:-1]]).view(np.int64), np.asarray(part.column("plain")) ^ (salt & 0xFFFF)))
            yield batch({"doc_id": part.column("doc_id"), "k1": keys[0], "k2": keys[1], "n_words": n, "signature": pa.FixedSizeListArray.from_arrays(pa.array(registers.ravel()), SIZE).cast(pa.list_(pa.int32())), "total": whole, "plain": plain, "odd": pa.FixedSizeListArray.from_arrays(pa.array(odd.ravel()), PARITIES).cast(pa.list_(pa.int64()))}, schema)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2 (equal for equal words), n_words, signature."""
    return texts(docs, id_col, text_col).withColumn("plain", F.xxhash64("text")).mapInArrow(_sketched, _SKETCH)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
    for rows in batches:
        for low, high in passes(rows.column("text_a")):  # likely pairs are about as long as each other
            part = rows.slice(low, high - low)
            sides = []
            for name in ("text_a", "text_b"):
                doc, value, weight = elements(*shingles(words(part.column(name)), SHINGLE))
                cut = np.searchsorted(doc, np.arange(high - low + 1))
                sides.append([(value[i:j], weight[i:j]) for i, j in zip(cut, cut[1:])])
            yield batch({"a": part.column("a"), "b": part.column("b"), "similarity": [probability_jaccard(x, y) for x, y in zip(*sides)]}, schema)


def texts_of(ids: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """doc_id, text of the given doc_ids, stored. Most other texts are dropped before the shuffle by reduced ids."""
    wanted = staged(ids.select("doc_id").distinct(), f"ids-{label}")
    reduced = lambda c: F.pmod(F.xxhash64(c), F.lit(REDUCED)).cast("int")
    some = wanted.select(reduced("doc_id").alias("_reduced")).distinct()
    near = docs.join(F.broadcast(some), reduced("doc_id") == F.col("_reduced"), "left_semi")
    return staged(near.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), f"texts-{label}")


def verify(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose exact similarity is at least ``threshold``."""
    own = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, "of-pairs")
    both = pairs.join(own.selectExpr("doc_id as a", "text as text_a"), "a").join(own.selectExpr("doc_id as b", "text as text_b"), "b")
    return both.mapInArrow(_alike, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("shingle", pa.int64()), ("share", pa.float64()), ("total", pa.int64()), ("plain", pa.bool_())])
    for rows in batches:
        ids = np.asarray(rows.column("doc_id"))
        for low, high in passes(rows.column("text")):
            doc, value, weight = elements(*shingles(words(rows.column("text").slice(low, high - low)), SHINGLE))
            total, distinct = np.bincount(doc, weights=weight, minlength=1)[doc], np.bincount(doc, minlength=1)[doc]
            yield batch({"doc_id": ids[low:high][doc], "shingle": value.view(np.int64), "share": weight / total, "total": total.astype(np.int64), "plain": total == distinct}, schema)


def sharing_prefix(labelled: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of all documents in ``labelled`` (doc_id, label) with different labels that can reach ``threshold``."""
    held = texts_of(labelled, docs, "open").mapInArrow(_weighed, "doc_id long, shingle long, share double, total long, plain boolean")
    held = staged(held, "shingles")
    ranked = held.join(held.groupBy("shingle").agg(F.count("*").alias("n")), "shingle")
    before = F.sum("share").over(Window.partitionBy("doc_id").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1))
    prefix = ranked.withColumn("before", F.coalesce(before, F.lit(0.0))).where((F.col("before") <= 1 - threshold + 1e-9) & (F.col("n") > 1))
    cell = f"pmod(shingle, {64 * PARITIES})"
    parity = [f"bit_xor(if({cell} div 64 = {k}, shiftleft(1L, cast({cell} % 64 as int)), 0L))" for k in range(PARITIES)]
    odd = held.groupBy("doc_id").agg(F.expr(f"array({', '.join(parity)})").alias("odd"))
    prefix = prefix.join(labelled, "doc_id").join(odd, "doc_id")
    prefix = staged(prefix.selectExpr("doc_id as id", "shingle", "label", "total", "total * (1 - before) as left", "plain", "odd"), "prefixes")
    one, two = (prefix.select([F.col(c).alias(f"{side}_{c}") for c in prefix.columns]) for side in "ab")
    # common shingles of two sets are at least t / (1 + t) of both together, and none comes before the first shared one
    enough = f"least(a_left, b_left) >= {threshold / (1 + threshold)} * (a_total + b_total) - 1e-6"
    able = possible(threshold, enough)
    return one.join(two, F.expr(f"a_shingle = b_shingle and a_id < b_id and a_label <> b_label and {able}")).selectExpr("a_id as a", "b_id as b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """doc_id, label (smallest id of its component), by turns of large and small stars until nothing changes.

    Each turn links ids to the smallest neighbour by an aggregate and a join, so a hub is folded before the shuffle and its
    join can be split; each turn is written to the shared folder.
    """
    def mark(df):
        return df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()

    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(now)
    while True:
        both = now.union(now.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v as u", "m as v").where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v")
        now = staged(small.union(least.selectExpr("u", "m as v")).distinct(), "small-star")
        after = mark(now)
        if after == before:
            return now.selectExpr("u as doc_id", "v as label")
        before = after


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_words; one row per input row."""
    rows = texts(docs, id_col, text_col)
    drawn = staged(sketch(rows), "sketch")
    groups = drawn.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    groups = staged(groups, "groups")
    nodes = drawn.where("n_words > 0").join(groups, ["k1", "k2"]).where("doc_id = node").selectExpr("node as id", "signature", "total", "plain", "odd").dropDuplicates(["id"])
    nodes = staged(nodes, "nodes")
    bands = [f"xxhash64({band}, {', '.join(f'signature[{band * ROWS + i}]' for i in range(ROWS))})" for band in range(BANDS)]
    buckets = nodes.selectExpr("id", f"posexplode(array({', '.join(bands)})) as (band, bucket)")
    crowds = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = staged(buckets.join(crowds, "bucket"), "buckets")

    # seven bits of each register are enough for the estimate
    short = nodes.selectExpr("id", "transform(signature, x -> cast(x & 127 as tinyint)) as s", "total", "plain", "odd")
    one, two = (short.select([F.col(c).alias(side if c == "id" else f"{side}_{c}") for c in short.columns]) for side in "ab")
    alike = f"aggregate(zip_with(a_s, b_s, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x) >= {(threshold - SLACK) * SIZE}"
    circle = f"pmod(xxhash64(id, bucket), cast(ceil(n / {CIRCLE}) as bigint))"
    dealt = crowded.selectExpr("id", "bucket", f"{circle} as circle", f"n <= {CIRCLE} as whole")
    met = dealt.withColumnRenamed("id", "a").join(dealt.selectExpr("id as b", "bucket", "circle"), ["bucket", "circle"]).where("a < b")
    met = met.groupBy("a", "b").agg(F.max("whole").alias("whole"))
    # no later step looks at a pair that met in a whole bucket, so only a bound may drop it
    likely = met.join(one, "a").join(two, "b").where(f"({possible(threshold)}) and (whole or {alike})").select("a", "b")
    tried = staged(likely, "pairs")
    links = staged(verify(tried, rows, threshold), "links")
    label = components(links)

    # large buckets that still hold several components: an exact join across components
    large = crowded.where(f"n > {CIRCLE}").join(label.withColumnsRenamed({"doc_id": "id"}), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = large.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    open_ = staged(large.join(mixed, "bucket").select(F.col("id").alias("doc_id"), "label").distinct(), "open")
    rest = staged(sharing_prefix(open_, rows, threshold).join(tried, ["a", "b"], "left_anti"), "rest-pairs")
    if not rest.isEmpty():
        more = staged(verify(rest, rows, threshold), "rest-links")
        if not more.isEmpty():
            label = components(links.unionByName(more))

    return (
        drawn.join(groups, ["k1", "k2"], "left").join(label.withColumnRenamed("doc_id", "node"), "node", "left")
        .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node")).alias("class_id"), "n_words")
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stand for their class: the smallest doc_id, once. Rows without id stay.

    Where a doc_id has several texts, each is a document of its own: the one with the smallest hash goes by the id, the others by
    numbers above all ids (which have to be below 2**62), so a text that no other resembles is never lost.
    """
    number, own, hashed, copy, kept_id = (fresh(docs, name) for name in ("number", "own_id", "text_hash", "copy", "kept_id"))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    told = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias(own), text.alias(hashed))
    several = told.groupBy(own).agg(F.min(hashed).alias("low"), F.max(hashed).alias("high"))
    several = staged(several.where("low <> high"), "repeated-ids")
    top = told.agg(F.max(own)).first()[0] or 0
    others = told.join(several, own).where(f"{hashed} <> low").select(own, hashed).distinct()
    others = staged(others.withColumn(number, F.monotonically_increasing_id() + F.lit(max(top, 0) + 1)), "further-texts")
    keyed = docs.join(others, (docs["doc_id"].cast("long") == others[own]) & (text == others[hashed]), "left").drop(own, hashed)
    keyed = keyed.withColumn(number, F.coalesce(number, F.col("doc_id").cast("long")))
    classes = near_duplicates(keyed, threshold, id_col=number)
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias(kept_id)).distinct()
    numbered = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(number).orderBy(F.xxhash64("text"))))
    chosen = numbered.where(F.col(copy) == 1).join(kept, F.col(number) == F.col(kept_id), "left_semi").select(*docs.columns)
    return chosen.unionByName(docs.where("doc_id is null"))
