"""Document fingerprints: a Merkle tree over sections (cut at empty lines), paragraphs (lines) and pieces of ``PIECE`` characters.

The hash of a paragraph is SHA-256 of its text, that of a section of its paragraphs' hashes, the root of its sections' hashes.
Cutting loses nothing, so roots are equal exactly if texts are. Below its paragraphs the tree has short hashes of pieces, so
an edit is located inside a long paragraph too. A fingerprint is the tree as text: the root, a colon, and the piece hashes
(8 hexadecimal digits) with "," between pieces, "." between paragraphs and ";" between sections. Everything here is SQL
functions of columns; there is no Python on the data path.

Likeness of two fingerprints: 1 for equal roots; otherwise equal branches drop out and it is twice the number of common
distinct pieces over the sum of both numbers of distinct pieces (0 if there is none).

Rows: null is empty; an empty text has a root and no piece. Rows are fingerprinted alone; equal texts have equal fingerprints.
``edit_report`` orders rows by doc_id, then by text; null ids come last. Extra columns are ignored; an empty table gives an
empty result, and of a single row the next one is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.words import staged, texts

PIECE = 24
#: Ids of one slice of ``neighbours``: 2**SLICE consecutive numbers.
SLICE = 10


def _sections(text: Column) -> Column:
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.split(s, "\n", -1))


def root(text: Column) -> Column:
    paragraphs = F.transform(_sections(text), lambda ps: F.sha2(F.concat_ws("", F.transform(ps, lambda p: F.sha2(p, 256))), 256))
    return F.sha2(F.concat_ws("", paragraphs), 256)


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string."""
    piece = lambda x: F.right(F.concat(F.lit("0000000"), F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))))), F.lit(8))
    pieces = lambda p: F.concat_ws(",", F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), piece))
    tree = F.concat_ws(";", F.transform(_sections(text), lambda ps: F.concat_ws(".", F.transform(ps, pieces))))
    return F.concat(root(text), F.lit(":"), tree)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1; null if either is null."""
    leaves = lambda f: F.array_distinct(F.filter(F.split(F.substring(f, 66, 2147483647), "[,.;]"), lambda x: x != ""))
    la, lb = leaves(a), leaves(b)
    total = F.size(la) + F.size(lb)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).when(
        a.isNotNull() & b.isNotNull(), F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(la, lb)) / total)
    )


def branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: array of (section, paragraph), from 0, of paragraphs of ``a`` that ``b`` has not at that place."""
    sections = lambda f: F.split(F.substring(f, 66, 2147483647), ";", -1)
    other = sections(b)
    differing = F.transform(
        sections(a),
        lambda s, i: F.when(F.coalesce(s == F.get(other, i), F.lit(False)), F.expr("cast(array() as array<struct<section: int, paragraph: int>>)")).otherwise(
            F.filter(
                F.transform(F.split(s, r"\.", -1), lambda p, j: F.struct(i.cast("int").alias("section"), F.when(F.coalesce(p == F.get(F.split(F.get(other, i), r"\.", -1), j), F.lit(False)), F.lit(None)).otherwise(j).cast("int").alias("paragraph"))),
                lambda x: x["paragraph"].isNotNull(),
            )
        ),
    )
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.expr("cast(array() as array<struct<section: int, paragraph: int>>)")).otherwise(F.flatten(differing))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, root, fingerprint."""
    return texts(docs, id_col, text_col).select("doc_id", root(F.col("text")).alias("root"), fingerprint(F.col("text")).alias("fingerprint"))


def following(values: DataFrame, shifts: tuple[int, ...] = (10, 20)) -> DataFrame:
    """(v, after): for each distinct number the next smaller one, null for the smallest.

    Numbers are ordered within groups of their leading bits, and only the largest number of each group goes on to the next
    level, so no task orders more than one group.
    """
    if not shifts:
        return values.select("v", F.lead("v").over(Window.orderBy(F.col("v").desc())).alias("after"))
    grouped = values.withColumn("g", F.shiftright("v", shifts[0]))
    tops = grouped.groupBy("g").agg(F.max("v").alias("top"))
    next_group = following(tops.select(F.col("g").alias("v")), shifts[1:]).withColumnsRenamed({"v": "g", "after": "h"})
    over = next_group.join(tops.withColumnsRenamed({"g": "h", "top": "first"}), "h", "left").select("g", "first")
    inside = F.lead("v").over(Window.partitionBy("g").orderBy(F.col("v").desc()))
    return grouped.withColumn("inside", inside).join(over, "g", "left").select("v", F.coalesce("inside", "first").alias("after"))


def edited(text: Column, source: Column) -> Column:
    """The last half (rounded down, in characters) of a text replaced by as many first characters of another one, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(source, F.lit(1), half))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed.

    ``changed`` locates the edit: (section, paragraph), from 0, of the paragraphs of the text that the edited one has not at that place.

    Each row is edited with the text of the next row in descending order. Texts are shuffled once, by slices of the id; the
    last row of a slice gets its neighbour from the first row of the next slice that has any.
    """
    rows = texts(docs, id_col, text_col).withColumn("slice", F.coalesce(F.shiftright("doc_id", SLICE), F.lit(-(1 << 62))))
    order = Window.partitionBy("slice").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    led = rows.withColumns({"after": F.lead("text").over(order), "place": F.row_number().over(order)})
    made = led.select(
        "slice", "doc_id", "text", "place", F.col("after").isNull().alias("last"), fingerprint(F.col("text")).alias("fingerprint"),
        F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("after")).alias("edited"),
    ).withColumns({"edited_fingerprint": fingerprint(F.col("edited")), "next_fingerprint": F.lead("fingerprint").over(order)})
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))}
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    done = staged(
        made.withColumns(near).select(
            *[c for c in out if c != "edited_sha256"], F.sha2("edited", 256).alias("edited_sha256"), "slice", "last",
            (F.col("place") == 1).alias("head"), F.when(F.col("last") | (F.col("place") == 1), F.col("text")).alias("edge_text"),
        ),
        "fingerprints",
    )
    heads = done.where("head").selectExpr("slice as next_slice", "edge_text as after", "fingerprint as next_fingerprint")
    slices = staged(done.where("head").selectExpr("slice as v"), "slices")
    top = slices.agg(F.max("v")).first()[0]
    # after the last slice comes the first one again
    ring = following(slices).select(F.col("v").alias("slice"), F.coalesce("after", F.lit(top).cast("long")).alias("next_slice"))
    edges = done.where("last").join(ring, "slice").join(heads.drop("fingerprint"), "next_slice").withColumn("edited", edited(F.col("edge_text"), F.col("after")))
    edges = edges.withColumns({"edited_fingerprint": fingerprint(F.col("edited")), "edited_sha256": F.sha2("edited", 256)}).withColumns(near)
    both = done.where("not last").select(*out).unionByName(edges.select(*out))
    return both.withColumn("changed", branches(F.col("fingerprint"), F.col("edited_fingerprint")))
