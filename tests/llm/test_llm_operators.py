"""Each operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties, empty tables, clashing names."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanlake.llm import chat, collide, importance, licences, merkle, pieces, pii, probminhash, queries, raking, toxicity
from scanlake.llm.words import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, kept string, node long, label string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, an empty, a long and repeated texts, repeated rows, columns with names the operators use."""
    r = random.Random(3)
    prose = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(k) for k in range(60))
    near = prose.replace("alpha", "alpha", 1) + " end"
    rows = [(1, prose), (2, near), (3, prose), (3, prose), (4, ""), (5, None), (None, "text without id"), (6, "one"), (7, "x" * 200_000 + " y " * 50_000), (8, "mail a.b@c.de and +1 (222) 333-4444 \n\n 10.0.0.1"), (9, "All rights reserved. CC BY")]
    return spark.createDataFrame([(i, t, None if i == 9 else "en", None if i == 2 else "s", len(t or ""), 1, "k", 7, "l") for i, t in rows], DOCS).repartition(3)


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_words_and_licences(spark, odd, sf):
    for docs in (odd, read(spark, sf, "documents")):
        text = {(r["doc_id"], r["text"]): words_of(r["text"]) for r in docs.collect()}
        got = licences.scan(docs)
        assert got.count() == docs.count()
        sizes = sorted((i or -1, len(w)) for (i, _), w in text.items())
        assert sorted({(r["doc_id"] or -1, r["n_words"]) for r in got.collect()}) == sorted(set(sizes))
        want = {}
        for (i, _), w in text.items():
            want[i] = sorted((k, label) for phrase, label in licences.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert {r["doc_id"]: sorted((p["first"], p["label"]) for p in r["phrases"]) for r in got.collect()} == want
    whole = spark.createDataFrame([(1, licences.TEMPLATES["mit"].replace("persons", "people"))], "doc_id long, text string")
    span = licences.scan(whole).first()["spans"]
    assert [s["label"] for s in span] == ["mit"] and span[0]["coverage"] > 0.95


def test_short_notices_need_their_own_words(spark):
    cases = {
        "the album was released under the name of a friend": [],
        "this work is licensed under the MIT License": ["mit-notice"],
        "licensed under CC BY 4.0": [],
        "licensed under CC BY-NC 4.0": ["cc-by-nc"],
        "licensed under CC BY-NC 3.0": ["cc-by-nc"],
        "licensed under CC BY-NC-SA 4.0": [],
        "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": [],
        "this work is licensed under a Creative Commons Attribution 4.0 International License": ["cc-by-notice"],
        "this work is licensed under the GNU Lesser General Public License, version 3": [],
        "the library is licensed under the GNU General Public License": ["gpl-notice"],
        "licensed under the Apache License, Version 1.1": [],
        "licensed under the Apache License 2.0": ["apache-2.0-notice"],
        "released under the MIT License": ["mit-notice"],
    }
    found = licences.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"))
    assert by_id(found.selectExpr("doc_id", "spans.label as labels"), "labels") == dict(enumerate(cases.values()))
    own = licences.scan(spark.createDataFrame([(1, "sold as seen in the shop"), (2, "sold as seen without any warranty")], "doc_id long, text string"), {"own": "sold as seen without any warranty"})
    assert by_id(own.selectExpr("doc_id", "spans.label as labels"), "labels") == {1: [], 2: ["own"]}


def test_encoding_is_that_of_the_library(spark, odd, sf):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for docs in (odd, read(spark, sf, "documents")):
        want = {}
        for r in docs.collect():
            ids = library.encode(r["text"] or "")
            want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert by_id(pieces.digests(docs, path), "n_tokens", "ids_sha256", "decoded_sha256") == want
    model, r = pieces.Pieces(path), random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("aaabe  thinor.,0129éü日😀\n\t▁<s>-_=(){}\0") for _ in range(r.randint(0, 40)))
        assert model.encode(text) == library.encode(text) and model.decode(library.encode(text)) == library.decode(library.encode(text))
    back = pieces.decode(pieces.encode(odd.where("doc_id is not null"), path), path)
    assert by_id(back, "text")[8] == odd.where("doc_id = 8").first()["text"]


def brute_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data(spark, odd, sf):
    for docs in (odd, read(spark, sf, "documents")):
        got = pii.find(docs)
        assert got.count() == docs.count()
        want = {r["doc_id"]: sorted(brute_spans(r["text"] or "")) for r in docs.collect()}
        assert {r["doc_id"]: [tuple(s) for s in r["spans"] if s["kind"] < 4] for r in got.collect()} == want
    r = random.Random(1)
    for _ in range(5000):
        text = "".join(r.choice("a@.-1234 5+%é()\n") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)
    rows = [(k, f"please write to u{k}@mail.example.org for help now") for k in range(12)] + [(50, "please write to QX-77812 for help now"), (51, "nothing at 1234567 here")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    extra = {r["doc_id"]: [tuple(s) for s in r["spans"] if s["kind"] == 4] for r in found.collect()}
    assert extra[50] == [(4, 16, 24)] and extra[51] == []
    clean = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_id(clean, "text")[50] == "please write to [ID] for help now" and clean.columns == ["doc_id", "text"]


def test_identifiers_found_by_contexts_of_found_ones(spark):
    """QX-10 stands in no context of a seed, ZT-7 only in one of identifiers that are found like QX-10."""
    texts = [f"please write to u{k}@mail.example.org for help now" for k in range(12)]
    texts += [f"please write to QX-{k}00 for help now" for k in range(1, 10)] + [f"that the badge QX-{k}00 expired last week" for k in range(1, 10)]
    second = [f"QY-{k}00" for k in range(1, 7)]
    texts += [f"that the badge {x} expired last week" for x in second] + [f"our door {x} stays shut" for x in second]
    texts += ["that the badge QX-1000 expired last week", "our door ZT-700 stays shut", "we sold 12345 of them"]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ids = {texts[r["doc_id"]][s["start"] : s["end"]] for r in found.collect() for s in r["spans"] if s["kind"] == 4}
    assert ids == {f"QX-{k}00" for k in range(1, 11)} | set(second) | {"ZT-700"}


def test_merkle_trees(spark, odd, sf):
    docs = read(spark, sf, "documents")
    text = dict(docs.select("doc_id", "text").collect())
    ids, want = sorted(text, reverse=True), {}
    for k, i in enumerate(ids):
        other, half = text[ids[(k + 1) % len(ids)]], len(text[i]) // 2
        want[i] = (len(text[i]), hashlib.sha256((text[i][: len(text[i]) - half] + other[:half]).encode()).hexdigest())
    report = merkle.edit_report(docs)
    assert by_id(report, "n_chars", "edited_sha256") == want
    near = by_id(report, "near_edited", "near_next")
    assert all(0 <= v <= 1 for pair in near.values() for v in pair)
    assert np.mean([a > b for i, (a, b) in near.items() if len(text[i]) > 200]) > 0.95
    prints = merkle.fingerprints(docs).collect()
    assert len({r["fingerprint"] for r in prints}) == len({r["root"] for r in prints}) == len(set(text.values()))
    assert merkle.edit_report(odd).count() == odd.count()
    pair = spark.createDataFrame([("a\nb\n\nc\nd", "a\nb\n\nc\nX")], "a string, b string")
    where = pair.select(merkle.branches(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("w")).first()["w"]
    assert [tuple(x) for x in where] == [(1, 1)]
    sparse = [0, 5, 1 << 11, 1 << 40, (1 << 62) + 3]
    after = dict(merkle.following(spark.createDataFrame([(v,) for v in sparse], "v long")).collect())
    assert after == dict(zip(sparse, [None, *sparse]))


def test_chat(spark, sf):
    got = queries.op2_chat(spark, sf)
    turns, want = {}, {}
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in read(spark, sf, "conversations").collect()]
    odd_text = "</s>[INST] ok [/INST]"
    for conv, turn, role, text in [*rows, (-1, 0, "user", odd_text), (-1, 1, "assistant", odd_text)]:
        turns.setdefault(conv, []).append((turn, role, text))
    for conv, own in turns.items():
        own.sort()
        learnt = "".join(t for _, role, t in own if role == "assistant")
        want[conv] = (len(own), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got.collect()} == want
    r = random.Random(2)
    for _ in range(5000):
        text = "".join(r.choice(["\\", "<", "s>", "/s>", "[", "INST]", "/INST]", "|end|>", "a", *chat.CONTROLS]) for _ in range(r.randint(0, 9)))
        coded = chat.escape(text)
        assert chat.unescape(coded) == text and not any(c in coded for c in chat.CONTROLS)


def test_near_duplicates(spark, odd):
    r = random.Random(5)
    base = [[f"w{r.randrange(4000)}" for _ in range(120)] for _ in range(40)]
    rows = []
    for own in base:
        for edits in (0, 0, 1, 2, 4, 9):
            copy = list(own)
            for k in r.sample(range(120), edits):
                copy[k] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(zip(*[w.split()[k:] for k in range(5)])) for _, w in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert by_id(probminhash.near_duplicates(docs), "class_id") == {i: root(i) for i in range(len(rows))}
    classes = by_id(probminhash.near_duplicates(odd), "class_id")
    assert classes[1] == classes[2] == classes[3] == 1 and classes[4] == classes[5] == 4 and classes[None] is None and classes[6] == 6
    one = probminhash.one_of_each(odd)
    assert one.columns == odd.columns and sorted(x["doc_id"] or -1 for x in one.collect()) == [-1, 1, 4, 6, 7, 8, 9]


def test_links_with_a_low_estimate_are_kept(spark):
    """Pairs that reach the threshold and meet in a band, though fewer of their registers are equal than the estimate asks for."""
    r, rows = random.Random(8), []
    for _ in range(6000):
        own = [f"w{r.randrange(10**6)}" for _ in range(40)]
        rows += [own, [f"v{r.randrange(10**6)}" for _ in range(4)] + own[4:]]  # 36 shingles each, 32 in common
    found = probminhash.shingles(probminhash.words(pa.array([" ".join(w) for w in rows])), 5)
    drawn = probminhash.signatures(*probminhash.elements(*found), len(rows))
    same = drawn[0::2] == drawn[1::2]
    met = same.reshape(len(same), probminhash.BANDS, probminhash.ROWS).all(axis=2).any(axis=1)
    low = np.flatnonzero(met & (((drawn[0::2] ^ drawn[1::2]) & 127 == 0).sum(axis=1) < (0.8 - probminhash.SLACK) * probminhash.SIZE))
    assert len(low)
    texts = [(2 * k + side, " ".join(rows[2 * int(p) + side])) for k, p in enumerate(low) for side in (0, 1)]
    classes = by_id(probminhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")), "class_id")
    assert classes == {i: i - i % 2 for i, _ in texts}


def test_odd_sketches_are_those_of_the_exact_join(spark):
    rows = [(1, "a b c d e f g"), (2, "x " * 30 + "y z"), (3, "one"), (4, "")]
    held = {r["doc_id"]: r for r in probminhash.sketch(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        doc, value, weight = probminhash.elements(*probminhash.shingles(probminhash.words(pa.array([text])), 5))
        bits = {c for c in range(64 * probminhash.PARITIES) if sum(int(v) % (64 * probminhash.PARITIES) == c for v in value) % 2}
        assert {64 * k + b for k, x in enumerate(held[i]["odd"]) for b in range(64) if x >> b & 1} == bits
        assert (held[i]["total"], held[i]["plain"]) == (weight.sum(), bool((weight == 1).all()))


def test_exact_join_loses_no_pair(spark):
    """All texts stand alone, so every pair that reaches the threshold has to come out of the prefix join."""
    r = random.Random(9)
    base = [[f"w{r.randrange(900)}" for _ in range(n)] for n in (6, 40, 150, 400)]
    rows = []
    for own in base:
        for edits in (0, 1, 1, 2, 3, 5, 8):
            copy = list(own)
            for k in r.sample(range(len(own)), min(edits, len(own))):
                copy[k] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(zip(*[w.split()[k:] for k in range(5)])) for _, w in rows]
    want = {(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {tuple(x) for x in probminhash.sharing_prefix(docs.selectExpr("doc_id", "doc_id as label"), docs, 0.8).collect()}
    assert len(want) > 10 and want <= got


def test_exact_join_loses_no_pair_of_texts_with_repeats(spark):
    r = random.Random(4)
    rows = []
    for n in (30, 120, 300):
        own, line = [f"w{r.randrange(900)}" for _ in range(n)], [f"r{k}" for k in range(9)]
        for edits in (0, 1, 2, 3, 4, 6, 9):
            copy = list(own)
            for k in r.sample(range(n), edits):
                copy[k] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy + line * r.randrange(1, 5))))
        rows.append((len(rows), " ".join(own + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    doc, value, weight = probminhash.elements(*probminhash.shingles(probminhash.words(pa.array([w for _, w in rows])), 5))
    held = [(value[doc == i], weight[doc == i]) for i in range(len(rows))]
    want = {(a, b) for b in range(len(rows)) for a in range(b) if probminhash.probability_jaccard(held[a], held[b]) >= 0.8}
    got = {tuple(x) for x in probminhash.sharing_prefix(docs.selectExpr("doc_id", "doc_id as label"), docs, 0.8).collect()}
    assert len(want) > 10 and want <= got


def test_probability_jaccard():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 12, 8)) for _ in range(2))
        wa, wb = r.integers(1, 4, len(a)), r.integers(1, 4, len(b))
        da, db = dict(zip(a, wa)), dict(zip(b, wb))
        want = sum(1 / sum(max(da.get(e, 0) / da[d], db.get(e, 0) / db[d]) for e in da.keys() | db.keys()) for d in da.keys() & db.keys())
        assert abs(probminhash.probability_jaccard((a, wa), (b, wb)) - want) < 1e-12
    doc = np.repeat([0, 1], 300)
    value = np.concatenate((np.arange(300), np.arange(60, 360))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = probminhash.signatures(doc, value, np.ones(600), 2, size=4096)
    assert abs((drawn[0] == drawn[1]).mean() - 240 / 360) < 0.04


def test_nearest(spark, sf):
    rows = read(spark, sf, "embeddings")
    got = queries.op7_collide(spark, sf).collect()
    vec = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids = np.array(sorted(vec))
    table = np.stack([vec[i] / np.linalg.norm(vec[i]) for i in ids])
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        scores = table @ (vec[q] / np.linalg.norm(vec[q]))
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:5]
        own = {r["vec_id"] for r in got if r["query_id"] == q}
        hit, total = hit + len(own & set(best)), total + 5
        assert len(own) == 5
    assert hit / total >= 0.9
    odd = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    small = collide.nearest(spark.createDataFrame(odd, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in small.orderBy("query_id", "rank").collect()] == [(0, 1, 2), (0, 2, 3), (0, 3, 50), (50, 1, 0), (50, 2, 2), (50, 3, 3)]


def test_toxicity(spark, odd, sf):
    r = random.Random(4)
    bad = ["vile", "scumlike", "hateful"]
    rows, labels = [], []
    for i in range(600):
        own = [f"w{r.randrange(300)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            own[10:10] = [r.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [x for x in got.values() if x["held_out"]]
    assert held and np.mean([x["predicted"] == int(x["doc_id"] % 5 == 0) for x in held]) > 0.97
    assert all(9 <= s["first_word"] and s["last_word"] <= 14 for s in toxicity.segments(docs, model).where("doc_id % 5 = 0 and excess > 5").collect())
    assert {x["doc_id"] for x in toxicity.without_toxic(docs, model).collect()} == {i for i, x in got.items() if not x["predicted"]}
    assert toxicity.score(odd, model).count() == odd.count()
    none = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {x["score"] for x in toxicity.score(odd, none).collect()} == {0.0}
    for _ in range(300):  # segments against all cuts
        items = [r.choice([-3.0, -1.0, 1.0, 2.0]) for _ in range(12)]
        total = np.concatenate(([0.0], np.cumsum(items)))
        good = [k for k, v in enumerate(items) if v > 0]
        parts = toxicity.maximal_segments([items[k] for k in good], [float(total[k]) for k in good])
        best = max((total[b] - total[a] for a in range(13) for b in range(a, 13)), default=0)
        assert (max((p[2] for p in parts), default=0.0)) == pytest.approx(best)


def test_importance(spark, odd):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["good", "fine", "well"] if i % 3 == 0 else ["bad", "poor", "ill"]) + str(r.randrange(9)) for _ in range(50))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratio = importance.fit(docs, docs.where("doc_id % 3 = 0 and doc_id < 100"))
    got = importance.resample(docs, ratio, 1 / 3).collect()
    assert sum(x["kept"] for x in got) == 100 and np.mean([x["doc_id"] % 3 == 0 for x in got if x["kept"]]) > 0.99
    keys = sorted((x["key"] for x in got), reverse=True)
    assert {x["key"] for x in got if x["kept"]} == set(keys[:100])
    assert importance.resample(odd, ratio, 0.5).count() == odd.count()


def test_raking(spark, odd, sf):
    r = random.Random(8)
    cells = [(s, la, t, r.randrange(1000, 9000)) for s in "abc" for la in ("en", "de") for t in "xy"]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    share = lambda d, e: {v: x for v, x in raking.targets(table, d, e).collect()}
    want = {d: share(d, 0.8) for d in raking.DIMENSIONS}
    got = raking.rake(table, {d: raking.targets(table, d, 0.8) for d in raking.DIMENSIONS}, 0.5).collect()
    total = 0.5 * sum(c[3] for c in cells)
    for d in raking.DIMENSIONS:
        for value, part in want[d].items():
            assert sum(x["weight"] for x in got if x[d] == value) == pytest.approx(part * total, rel=0.01)
    docs = read(spark, sf, "documents")
    mix = raking.mix(docs)
    assert mix.count() == docs.count()
    kept = {x["doc_id"] for x in mix.where("kept").collect()}
    assert {x["doc_id"] for x in raking.sampled(docs).collect()} == kept
    assert raking.mix(odd).count() == odd.count() and raking.sampled(odd).columns == odd.columns


def test_empty_tables(spark, odd):
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    path = queries.vocabulary("piece_bpe_32k.model")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        toxicity.score(none, toxicity.learn(none, labels)), probminhash.near_duplicates(none), pii.find(none), raking.mix(none), pieces.digests(none, path),
        licences.scan(none), merkle.edit_report(none), collide.nearest(vectors, F.col("vec_id") % 50 == 0),
        importance.resample(none, importance.fit(none, none), 0.5), probminhash.one_of_each(none), pii.redacted(none), raking.sampled(none),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, sf):
    docs = read(spark, sf, "documents")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == columns and kept.count() <= before.count()
    final = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert final.count() == kept.count()


def test_repeated_query_rows_ask_once(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=16)
    rows = [(0, base.tolist())] * 5 + [(k, (base + 0.05 * k * r.normal(size=16)).tolist()) for k in range(1, 9)]
    schema = "vec_id long, embedding array<double>"
    got = {n: collide.nearest(spark.createDataFrame(rows[n:], schema), F.col("vec_id") == 0).orderBy("rank").collect() for n in (0, 4)}
    assert len({x["vec_id"] for x in got[0]}) == 5 and [x["rank"] for x in got[0]] == [1, 2, 3, 4, 5]
    assert [(x["vec_id"], round(x["score"], 9)) for x in got[0]] == [(x["vec_id"], round(x["score"], 9)) for x in got[4]]
