"""The operators on the driver's tables, with production parameters and whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import chat, collide, divergence, idfiles, importance, licences, merkle, pieces, pii, probminhash, raking, resampling, toxicity
from scanlake.llm.words import read
from scanlake.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[plan.__name__] = plan
    return plan


@_query
def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed by target (labelled quality 1, not held out) over raw; 85 % are drawn."""
    docs = read(spark, sf_dir, "documents")
    target = importance.labelled_target(docs, read(spark, sf_dir, "labels"), (F.col("quality") == 1) & (toxicity.fold() != 0))
    return importance.resample(docs, importance.fit(docs, target), 0.85)


@_query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_turns(turns, path, pattern), path, pattern)


@_query
def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(read(spark, sf_dir, "documents"))


@_query
def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(read(spark, sf_dir, "documents"))


@_query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in pii.KINDS)
    return f"array_join(transform({spans}, s -> concat_ws(':', elt(s.kind + 1, {names}), s.start, s.end)), ',')"


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    count = {f"n_{name}": F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as long)") for k, name in enumerate(pii.KINDS)}
    return found.select(
        "doc_id", *[v.alias(k) for k, v in count.items()], F.expr(f"sha2({_joined('filter(spans, s -> s.kind < 4)')}, 256)").alias("base_sha256"), F.expr(_joined("spans")).alias("spans")
    )


@_query
def op7_collide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collide.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read(spark, sf_dir, "documents"))
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.first").alias("first_word"), F.array_max("phrases.first").alias("last_word"),
        labels(F.col("phrases.label")).alias("base_labels"), labels(F.col("phrases.label"), F.col("spans.label")).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.coverage"), F.lit(0.0))).alias("score"),
    )


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


@_query
def op10_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix(read(spark, sf_dir, "documents"))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the texts of ``benchmark``."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# CRC-32 byte by byte, by a table that is made from the polynomial; each different word once
ORACLES["op11_resampling"] = rf"""
with crc_table as (
    select list(c order by n) as crcs from (
        select n, list_reduce(list_prepend(n, range(8)), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) t(n))),
words as (
    select 'd' as side, k, unnest(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
    from (select row_number() over () as k, text from documents)
    union all
    select 'b', 0, unnest(regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
bucket_of as (
    select word, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint)),
        lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
    from (select distinct word from words), crc_table),
placed as (select side, k, bucket from words join bucket_of using (word)),
tallies as (
    select b.bucket, coalesce(s, 0) as s, coalesce(t, 0) as t from (select unnest(range(10000)) as bucket) b
    left join (select bucket, count(*) as s from placed where side = 'd' group by 1) using (bucket)
    left join (select bucket, count(*) as t from placed where side = 'b' group by 1) using (bucket)),
gains as (
    select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from tallies) + 10000) / ((s + 1)::double * ((select sum(t) from tallies) + 10000))))::bigint as gain
    from tallies),
weighed as (
    select k, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from placed join gains using (bucket) where side = 'd' group by 1),
scored as (
    select d.k, doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from (select row_number() over () as k, doc_id from documents) d left join weighed using (k)),
able as (select k, row_number() over (order by score desc, doc_id nulls last, n_features) as place, count(*) over () as able_n from scored where n_features >= 20)
select doc_id::bigint as doc_id, n_features::bigint as n_features, weight, score, case when place <= 10 * able_n // 100 then place end as rank
from scored left join able using (k)
"""


@_query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


ORACLES["op12_divergence"] = rf"""
with docs as (select row_number() over () as k, {_FOLDED} as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
found as (select k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as all_n from found group by 1, 2 having count(distinct k) >= 30),
sizes as (select lang, count(*) as v, sum(all_n) as all_total from kept group by 1),
groups as (select distinct lang, source from docs),
counted as (select lang, source, term, count(*) as n from found semi join kept using (lang, term) group by 1, 2, 3),
cells as (
    select g.lang, g.source, k.term, k.all_n, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (partition by g.lang, g.source) as total
    from groups g join kept k using (lang) left join counted using (lang, source, term)),
shares as (
    select lang, source, term, n, (1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v))::bigint as p, (1 + (1000000000::hugeint * (all_n + 5)) // (all_total + 5 * v))::bigint as q
    from cells join sizes using (lang)),
pairs as (
    select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join shares x on x.lang = a.lang and x.source = a.source
    left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
    group by 1, 2, 3),
ranked as (
    select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
    union all
    select * from (
        select lang, source, 'term' as part, term as item, (p - q)::bigint as value, row_number() over (partition by lang, source order by p - q desc, term) as rank
        from shares where n > 0 and p > q) where rank <= 50)
select lang, source, part, item, value, rank::int as rank from ranked
"""


@_query
def op13_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the ids of all documents are written to the shared folder, and what is returned is read from them."""
    out = shared_dir(spark, "token-ids")
    idfiles.write(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), out)
    return idfiles.digests(spark, out)
