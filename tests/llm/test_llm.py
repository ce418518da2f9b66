"""The training-data operators against brute force, round trips and held-out labels, with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from framesift.llm import (
    components,
    kdtree,
    language_id,
    mixing,
    nbfeatures,
    ngram_join,
    pieces,
    preference,
    queries,
    quality_classifier,
    quality_rules,
    token_rollup,
    toxicity,
)
from framesift.llm.common import scratch_path, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "clash") for i, t, s in rows], DOCS)


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, long, "b"), (5, "one two", "b"), (5, "one two", "b"), (None, "no id here", "a"), (6, "▁ \U0001f600 漢字 é", "b")]


# ---------------------------------------------------------------- 1


def repeat_words(w):
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)})


def test_quality_rules_brute_force(spark):
    rows = [(10, "a b c d e f a b c d e g h", "x"), (11, "same line\nother words\nsame line\n\n\n##", "x"), (12, " ".join("abcdefghijkl"), "x"), *odd_rows()]
    df = docs(spark, rows)
    trusted = spark.createDataFrame([(12,), (10,)], "doc_id long")
    weights = quality_rules.bucket_weights(df.select("doc_id", "text"), trusted)
    got = collections.defaultdict(list)
    for r in quality_rules.score_rules(df, weights).collect():
        got[r["doc_id"]].append(r)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def h(w):
        return xxhash.xxh64_intdigest(w.encode(), 42)

    def grams(t):
        hs = [h(w) for w in WORD.findall(t or "")]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), a) for a, b in zip(*[[xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42) for x in hs], hs[1:]], strict=False)]
        return [x >> 48 for x in hs] + [(x >> 48) + quality_rules.ORDER_BUCKETS for x in two]

    t, r = collections.Counter(), collections.Counter()
    for i, text, _ in rows:
        r.update(grams(text))
        if i in (10, 12):
            t.update(grams(text))
    size = 2 * quality_rules.ORDER_BUCKETS
    for i, text, _ in rows:
        w = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        row = got[i][0]
        assert row["n_words"] == len(w) and row["word_chars"] == sum(map(len, w))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or "")) and row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == repeat_words(w)
        assert row["base_failed"] == (len(w) < 10 or 100 * repeat_words(w) > 20 * len(w))
        g = grams(text)
        if g:
            llr = sum(math.log((t[x] + 1) / (t.total() + size)) - math.log((r[x] + 1) / (r.total() + size)) for x in g) / len(g)
            assert row["llr"] == pytest.approx(llr, abs=1e-9)
            assert row["kept"] == (not row["base_failed"] and llr >= quality_rules.THRESHOLD)
        else:
            assert row["llr"] is None and not row["kept"]
    assert len(got[5]) == 2


def test_quality_rules_without_trusted_or_rows(spark):
    df = docs(spark, [(1, " ".join("abcdefghijkl"), "x")])
    weights = quality_rules.bucket_weights(df, spark.createDataFrame([], "doc_id long"))
    assert quality_rules.score_rules(df, weights).first()["kept"]
    assert quality_rules.score_rules(df.limit(0), weights).count() == 0


# ---------------------------------------------------------------- 2 and 5


def made_documents(n=600, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abdeglnorst", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(20, 80))
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilefool", "zzrotten"]))
        out.append((i, " ".join(w), int(bad)))
    return out


@pytest.mark.parametrize("m", [toxicity, quality_classifier])
def test_classifiers(spark, m):
    rows = made_documents()
    df = docs(spark, [(i, t, "s") for i, t, _ in rows] + [(None, None, "s"), (9000, "", "s"), (9001, "x" * 1_200_000, "s")])
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = m.fit(df, labels)
    score = m.score_toxicity if m is toxicity else m.score_quality
    got = score(df, model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"]]
    assert held and all(r["doc_id"] is not None for r in held)
    right = [r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]
    assert np.mean(right) > 0.97
    one = m.fit(df, labels.withColumn("toxic", F.lit(1)).withColumn("quality", F.lit(1)))
    assert len({round(r["score"], 9) for r in score(df.limit(5), one).collect()}) == 1
    assert score(df.limit(0), model).count() == 0


def test_repeated_ids_are_one_training_document(spark):
    rows = docs(spark, [(1, f"copy {k % 3}", "a") for k in range(300)] + [(2, None, "a"), (None, "x", "a"), (3, "other", "a")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, toxic int")
    got = nbfeatures.training_rows(rows, labels, "toxic", F.lit(True)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "copy 0", 1), (2, None, 0), (3, "other", 1)]
    assert len(nbfeatures.training_rows(rows, labels, "toxic", F.lit(True), bound=2).collect()) <= 2


def test_labels_without_a_document_do_not_use_up_the_bound(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1)], "doc_id long, toxic int")
    order = [r["doc_id"] for r in labels.dropna().orderBy(F.xxhash64("doc_id")).collect()]
    kept = order[50:]  # the first half by hash was rejected by a stage before
    rows = docs(spark, [(i, "text", "a") for i in kept] + [(None, "text", "a")])
    got = nbfeatures.training_rows(rows, labels, "toxic", F.lit(True), bound=20).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(kept[:20])


@pytest.mark.parametrize("m", [toxicity, quality_classifier])
def test_only_buckets_with_a_ratio_reach_the_driver(spark, m):
    rows = made_documents(200)
    found = [nbfeatures.present(t, m.features) for _, t, _ in rows]
    n = [sum(y == k for _, _, y in rows) for k in (0, 1)]
    df = np.zeros((2, nbfeatures.DIM))
    for f, (_, _, y) in zip(found, rows, strict=True):
        df[y][f] += 1
    ratio = np.log((df[1] + 1) / (n[1] + 2)) - np.log((df[0] + 1) / (n[0] + 2))
    share = df.sum(0) / len(rows)
    clear = (df.sum(0) >= 5) & (abs(df[1] / n[1] - df[0] / n[0]) >= 4 * np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1])))
    got = nbfeatures.gather(spark.createDataFrame(rows, "doc_id long, text string, y int"), m.features)
    assert np.array_equal(got.buckets, np.flatnonzero(clear)) and 0 < clear.sum() < (df.sum(0) > 0).sum() / 2
    assert np.allclose(got.scale, ratio[clear]) and got.y.tolist() == [y for _, _, y in rows]
    assert all(np.array_equal(got.buckets[k], f[clear[f]]) for k, f in zip(got.lists, found, strict=True))
    assert nbfeatures.TRAIN_DOCS >= 8_000


def test_long_text_features_do_not_depend_on_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("abc déf\n", k=5000))
    whole = nbfeatures.present(text, quality_classifier.features)
    monkeypatch.setattr(nbfeatures, "PIECE", 64)
    assert np.array_equal(whole, nbfeatures.present(text, quality_classifier.features))


def test_dual_coordinate_descent_separates():
    rows = [np.array([0]), np.array([0, 2]), np.array([1]), np.array([1, 2])]
    w, b = quality_classifier.dual_coordinate_descent(rows, np.ones(3), np.array([1, 1, 0, 0]), cost=10)
    assert all((w[r].sum() + b > 0) == y for r, y in zip(rows, [1, 1, 0, 0], strict=True))


def toy_training(seed=11, n=300, d=40):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(np.int64)
    lists = [np.flatnonzero(rng.random(d) < np.where(np.arange(d) < 8, 0.15 + 0.5 * k, 0.2)).astype(np.int32) for k in y]
    return nbfeatures.Training(lists, y, np.arange(d, dtype=np.int32), rng.normal(size=d).astype(np.float32))


def dense(t):
    x = np.zeros((len(t.y), len(t.scale)))
    for i, k in enumerate(t.lists):
        x[i, k] = t.scale[k]
    return x


def test_hinge_loss_is_minimal():
    """The primal loss is convex, so no step in any direction makes it smaller if it is minimal; and
    it is near the dual, which bounds it from below, for multipliers found by projected ascent."""
    t = toy_training()
    w, b = quality_classifier.dual_coordinate_descent(t.lists, t.scale, t.y, epochs=2000)
    x, sign, cost = np.column_stack([dense(t), np.ones(len(t.y))]), np.where(t.y == 1, 1.0, -1.0), quality_classifier.COST

    def primal(v):
        return v @ v / 2 + cost * np.maximum(0, 1 - sign * (x @ v)).sum()

    v = np.append(w, b)
    rng = np.random.default_rng(1)
    for step in (1e-3, 1e-2, 0.1):
        assert all(primal(v + step * rng.normal(size=len(v))) >= primal(v) - 1e-6 for _ in range(300))
    z = sign[:, None] * x
    a, rate = np.zeros(len(t.y)), 1 / np.linalg.norm(z, 2) ** 2
    for _ in range(20_000):
        a = np.clip(a + rate * (1 - z @ (z.T @ a)), 0, cost)
    dual = a.sum() - (z.T @ a) @ (z.T @ a) / 2
    assert 0 <= primal(v) - dual + 1e-9 < 1e-2 * dual


def test_logistic_gradient_is_near_zero():
    t = toy_training()
    model = toxicity.fit_logistic(t)
    w = model.weights[: len(t.scale)] / t.scale
    x = dense(t)
    e = 1 / (1 + np.exp(-(x @ w + model.bias))) - t.y
    zero = np.abs(x.T @ (t.y.mean() - t.y)).max() / len(t.y)  # at the start
    assert np.abs(x.T @ e / len(t.y) + toxicity.PENALTY * w).max() < 0.1 * zero and abs(e.mean()) < 0.02


@pytest.mark.parametrize("m", [toxicity, quality_classifier])
def test_scores_are_those_of_the_model(spark, m):
    """Score by hand, from the weights and all n-grams of whole texts."""
    rows = made_documents(300)
    df = docs(spark, [(i, t, "s") for i, t, _ in rows])
    model = m.fit(df, spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in (m.score_toxicity if m is toxicity else m.score_quality)(df, model).collect()}
    for i, t, _ in rows[:40]:
        s = f" {t.lower()} " if m is toxicity else t
        grams = {b for n in m.ORDERS for b in (nbfeatures.present(s[k : k + n], lambda x, n=n: nbfeatures.char_ngrams(x, (n,))).tolist()[0] for k in range(len(s) - n + 1))}
        if m is quality_classifier:
            grams |= set(nbfeatures.repeat_ngrams(t, m.REPEATS).tolist())
        z = model.slope * (model.bias + sum(float(model.weights[g]) for g in grams)) + model.shift
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


@pytest.mark.parametrize("m", [toxicity, quality_classifier])
def test_empty_tables_and_ties(spark, m):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    score = m.score_toxicity if m is toxicity else m.score_quality
    assert score(none, m.fit(none, labels)).count() == 0
    some = docs(spark, odd_rows() + [(5, "one two", "b")])
    got = score(some, m.fit(some, labels)).collect()
    assert len(got) == 9 and len({r["score"] for r in got}) == 1


# ---------------------------------------------------------------- 3


def brute_phrases(sample: bytes, text: bytes) -> int:
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample and text[at : at + k] in sample:
            k += 1
        at += k
        n += 1
    return n


def test_cross_parsing_brute_force(monkeypatch):
    rng = random.Random(5)
    samples = {"x": bytes(rng.choices(b"abcd", k=3000)), "y": bytes(rng.choices(b"abef", k=2000))}
    p = language_id.Parser(samples)
    texts = [bytes(rng.choices(b"abcdefz", k=k)) for k in (0, 1, 7, 100, 256, 257, 512, 600, 5000)]
    # phrases over many blocks: passages of the samples, and all of one twice
    texts += [samples["x"][100:2900], samples["y"][:1999] + b"z" + samples["x"][:700], samples["x"] * 2, b"z" * 700]
    want = [[brute_phrases(samples[x], t) for x in p.langs] for t in texts]
    count, state = p.phrases([np.frombuffer(t, np.uint8) for t in texts])
    assert (count + (state != 0)).tolist() == want
    # the same by parts, each going on from the state before it
    for t, w in zip(texts, want, strict=True):
        total, state = np.zeros((1, 2), np.int64), None
        for at in range(0, len(t), 300):
            n, state = p.phrases([np.frombuffer(t[at : at + 300], np.uint8)], state)
            total += n
        assert state is None or (total + (state != 0))[0].tolist() == w
    words = [" ".join("".join(rng.choices("abcd", k=5)) for _ in range(300)), "abcd " * 9]
    whole = p.predict(words)
    monkeypatch.setattr(language_id, "CHUNK", 100)
    assert p.predict(words) == whole


def test_every_language_is_learned(spark):
    """Long texts, very short ones, rows that share an id, and equal rows."""
    rows = [(i, " ".join(f"lang{w % 7} u{w}" for w in range(i, i + 6000)), "long") for i in range(6)]
    rows += [(i, f"tiny{i % 9}", "tiny") for i in range(3000)]
    rows += [(10, f"sameid text{i}", "same id") for i in range(5000)] + [(11, "alike", "alike")] * 3000
    rows += [(None, "nobody", "no id"), (1, None, "no text"), (1, "", "empty"), (1, "lost", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {(r["lang"]) for r in d.filter(language_id.fold(F.col("doc_id"), 5) != 0).select("lang").distinct().collect()}
    got = language_id.learn_samples(d)
    assert set(got) == learned - {"no text", "empty", None} and {"long", "tiny", "same id", "alike"} <= set(got)
    assert len(got["long"]) > 10_000 and got["alike"] == b"alike " and len(got["tiny"]) < 200


def test_language_edges(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    samples = language_id.learn_samples(d)
    odd = language_id.predict_language(docs(spark, odd_rows() + [(7, "123 456 !!", "a")]), samples).collect()
    by = {r["doc_id"]: r for r in odd}
    assert {by[i]["lang_pred"] for i in (1, 2, 3, 7)} == {"und"} and by[5]["lang_pred"] in samples and len(odd) == 9
    assert {r["lang_pred"] for r in language_id.predict_language(d, {}).collect()} == {"und"}
    got = language_id.predict_language(d, samples).filter("held_out and length(text) > 200")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()
    assert language_id.learn_samples(d.limit(0)) == {}


# ---------------------------------------------------------------- 4


def test_top_k_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 4)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 5)).round(1)
    v[20:60] = v[20]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    extra = [(200, None), (300, [None] * 5), (400, [float("nan")] * 5), (500, [float("inf")] * 5), (None, [0.0] * 5), (600, [1.0, 2.0]), (601, [3.0, 1.0])]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>")
    p = kdtree.integer_points(df)
    ints = {i: [math.floor(1024 * a) for a in x] for i, x in rows} | {600: [1024, 2048], 601: [3072, 1024]}
    for block, shard in ((4096, 4096), (40, 30)):
        got = sorted(tuple(r) for r in kdtree.top_k(p, p, 10, block, shard).collect())
        want = []
        for q, a in ints.items():
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints.items() if i != q and len(a) == len(b))
            want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:10])]
        assert got == sorted(want)
    assert kdtree.top_k(p.limit(0), p.limit(0)).count() == 0
    big = kdtree.integer_points(spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, 3.0])], "vec_id long, embedding array<double>"))
    assert kdtree.top_k(big, big.filter("vec_id = 0"), 1).first()["vec_id"] == 1  # both clip to a long


# ---------------------------------------------------------------- 6


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return [(len(s), least[g]) for s, g in zip(sets, group, strict=True)]


@pytest.mark.parametrize("salt_df", [1 << 12, 3])  # 3: postings of frequent tokens are dealt to several groups
def test_jaccard_brute_force(spark, monkeypatch, salt_df):
    monkeypatch.setattr(ngram_join, "HOT_DF", 5)
    monkeypatch.setattr(ngram_join, "SALT_DF", salt_df)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("abcdefghij") + str(rng.randrange(40))
    passage = [word() for _ in range(30)]
    rows = [(100 + i, t, s) for i, (_, t, s) in enumerate(odd_rows())] + [(None, "no id here", "a"), (None, "Some Words only in two rows of null", "a"), (None, "some words only in two rows of null", "a")]
    for g in range(25):
        base = [word() for _ in range(rng.randint(3, 90))]
        if g % 2:
            base += passage
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 2 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows) * 7 % 1009 + 1000, " ".join(w), "s"))
    rng.shuffle(rows)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in ngram_join.jaccard_components(docs(spark, rows)).collect())
    want = sorted((i or 0, n, c or 0 if n else i or 0) for (i, *_), (n, c) in zip(rows, brute_components(rows), strict=True))
    assert got == want
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0
    assert ngram_join.jaccard_components(docs(spark, [(1, None, "a")])).first()["component_id"] == 1


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n, drop in ((0, 0), (1, 1), (40, 3), (150, 60), (2500, 400)):
        a = pool[:n]
        b = np.concatenate([a[drop:], pool[2900 : 2900 + drop]])
        bits = sum(int(x).bit_count() for x in (ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))
    assert ngram_join.sketch(pool[:5]).view(np.uint8).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    from framesift.llm import common

    b = common.utf8(" ".join("word%d" % (i % 97) for i in range(4000)) + "x" * 5000)
    whole = word_hashes(b)
    monkeypatch.setattr(common, "HASH_PIECE", 100)
    assert np.array_equal(whole, word_hashes(b)) and len(whole) == 4000


# ---------------------------------------------------------------- 7


def test_pieces_round_trip_and_seeds(spark):
    rows = odd_rows() + [(8, "a  b\n\n▁x\t" + chr(0), "a")]
    got = pieces.encode_documents(docs(spark, rows)).collect()
    assert all(r["decoded"] == r["text"] for r in got) and len(got) == len(rows)
    again = pieces.encode_documents(docs(spark, rows).repartition(3)).collect()
    key = lambda rs: sorted((r["doc_id"] or -1, r["text"] or "", r["piece_ids"] or []) for r in rs)
    assert key(got) == key(again)
    codec = pieces.PieceCodec(spark)
    apart = docs(spark, rows).withColumn("piece_ids", codec.pieces(F.col("doc_id"), F.col("text")))
    assert key(apart.collect()) == key(got)
    assert all(r["d"] == r["text"] for r in apart.select("text", codec.text(F.col("piece_ids")).alias("d")).collect())
    assert next(r for r in got if r["doc_id"] == 1)["piece_ids"] is None
    assert pieces.encode_documents(docs(spark, [])).count() == 0


def test_sampled_segmentations_have_the_lattice_distribution():
    ps = ["a", "b", "ab", "abb", "bb", "▁"]
    lattice = pieces.Lattice(ps + [""] * 256, [-1.5, -2.5, -1.25, -3.5, -2.25, -1.0] + [0.0] * 256, list(range(6, 262)))
    score = dict(zip(ps, [-1.5, -2.5, -1.25, -3.5, -2.25, -1.0], strict=False))

    def splits(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in score:
                yield from ((s[:k], *r) for r in splits(s[k:]))

    weight = {x: math.exp(sum(score[p] for p in x)) for x in splits("abbab")}
    n = 40_000
    got = collections.Counter(tuple(ps[i] for i in x) for x in lattice.encode(pieces.mix64(np.arange(n, dtype=np.uint64)), ["abbab"] * n))
    for x, w in weight.items():
        assert got[x] / n == pytest.approx(w / sum(weight.values()), abs=0.01)


# ---------------------------------------------------------------- 8


def test_rollup(spark):
    path = scratch_path(spark, "test-rollup")
    r = token_rollup.TokenRollup(spark, path)
    assert r.totals().count() == 0
    df = docs(spark, [(1, "a b c", "s"), (2, None, None), (2, None, None), (3, "d", "t")])
    words = token_rollup.word_tokens(F.col("text"))
    assert r.commit("b1", token_rollup.changes(df, words, "v1", 1))
    assert not r.commit("b1", token_rollup.changes(df, words, "v1", 1))
    r.commit("b2", token_rollup.changes(df.filter("doc_id = 3"), words, "v1", -1))
    r.commit("b3", token_rollup.revisions(df.filter("doc_id = 1"), words, F.lit(10), "v1"))
    r.commit("empty", token_rollup.changes(df.limit(0), words, "v1", 1))

    def totals():
        return sorted((x["source"] or "", x["n_docs"], x["n_tokens"]) for x in r.totals().collect())

    assert totals() == [("", 2, 0), ("s", 1, 10)]
    before = r.totals()
    r.compact()
    assert totals() == [("", 2, 0), ("s", 1, 10)] and before.count() == 2
    assert not r.commit("b2", token_rollup.changes(df, words, "v1", 1))
    r.commit("b4", token_rollup.changes(df.filter("doc_id = 3"), words, "v1", 1))
    assert totals() == [("", 2, 0), ("s", 1, 10), ("t", 1, 1)]
    r.vacuum()
    assert totals() == [("", 2, 0), ("s", 1, 10), ("t", 1, 1)]
    assert not r.commit("b1", token_rollup.changes(df, words, "v1", 1))
    r.compact()
    r.vacuum()
    assert totals() == [("", 2, 0), ("s", 1, 10), ("t", 1, 1)] and not r.commit("b4", token_rollup.changes(df, words, "v1", 1))
    with pytest.raises(ValueError):
        r.commit("../x", df)
    counts = [x[0] for x in df.select(token_rollup.bpe_tokens(F.col("text"))).collect()]
    assert counts[0] == 3 and counts[1] == 0


def test_batch_committed_during_a_compaction_counts_once(spark, monkeypatch):
    r = token_rollup.TokenRollup(spark, scratch_path(spark, "test-race"))
    one = token_rollup.changes(docs(spark, [(1, "a b", "s")]), token_rollup.word_tokens(F.col("text")), "v1", 1)
    r.commit("b1", one)
    listed = token_rollup.TokenRollup._sum

    def late(self, snapshot, batches):
        monkeypatch.setattr(token_rollup.TokenRollup, "_sum", listed)
        assert self.commit("b2", one)
        return listed(self, snapshot, batches)

    monkeypatch.setattr(token_rollup.TokenRollup, "_sum", late)
    r.compact()
    assert [(x["n_docs"], x["n_tokens"]) for x in r.totals().collect()] == [(2, 4)]
    assert not r.commit("b1", one) and not r.commit("b2", one)


def bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_bpe_counts_of_long_runs(spark):
    texts = ["a" + " " * 5000 + "b c", "x" + "\n" * 4097 + "y  ", " " * 9000, "\t" * 5000 + " z", "q" + " " * 1_000_000 + "r", "it's é漢<|endoftext|>\n\n  d"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(token_rollup.bpe_tokens(F.col("text"))).collect()
    assert [r[0] for r in got] == list(map(bpe(), texts))


def test_token_count_query(spark):
    """Words and bytes against SQL, BPE counts against another implementation of the tokenizer."""
    got = token_rollup.query(spark, SF).collect()
    c = duckdb.connect()
    c.execute(f"create view documents as from '{SF}/documents.parquet'")
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(r for r in got if r["tokenizer_version"] != "bpe-50k") == key(c.execute(token_rollup.WORDS_AND_BYTES).fetchall())
    count, want = bpe(), collections.Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if len(WORD.findall(r["text"] or "")) >= 10:
            want[r["source"], r["lang"]] += count(r["text"])
    assert {(r["source"], r["lang"]): r["n_tokens"] for r in got if r["tokenizer_version"] == "bpe-50k"} == want


# ---------------------------------------------------------------- 9


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out = 1.5 * sum(sizes.values()), {}
    live = list(order)
    while live:
        level = left / sum(w[s] for s in live)
        full = [s for s in live if w[s] * level > 2 * sizes[s]]
        if not full:
            return out | {s: w[s] * level for s in live}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            live.remove(s)
    return out


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    rows += [(1000, None, "e"), (None, "x y", "a"), (5, rows[5][1], rows[5][2])]
    df = docs(spark, rows)
    got = mixing.mix(mixing.sized_documents(df), group_docs=40, fan_in=3).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    taken = collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = mixing.mix(mixing.sized_documents(df.repartition(5)), group_docs=40, fan_in=3).collect()
    key = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["copies"]) for r in rs)
    assert key(got) == key(again)
    assert mixing.mix(mixing.sized_documents(df.limit(0))).count() == 0


def test_rows_that_share_an_id_are_dealt_to_bounded_groups(spark):
    rows = [(None, "x y z", "a")] * 2500 + [(7, "u v", "a")] * 500 + [(i, "w " * (i % 9 + 1), "b") for i in range(300)]
    df = docs(spark, rows).repartition(3)
    numbered = mixing.number_equals(df.select(F.coalesce("doc_id", F.lit(0)).alias("c"), F.monotonically_increasing_id().alias("row")))
    found = numbered.groupBy("c").agg(F.count("*").alias("n"), F.min("nth").alias("lo"), F.max("nth").alias("hi"), F.countDistinct("nth").alias("d"))
    assert all((r["lo"], r["hi"], r["d"]) == (0, r["n"] - 1, r["n"]) for r in found.collect())
    got = mixing.mix(mixing.sized_documents(df), group_docs=100, fan_in=3).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 9


def test_pivot_keeps_expected_copies():
    n, hits = 4000, 0
    for seed in range(n):
        draws = np.random.default_rng(seed).random(2)
        p, last = mixing.pivot(draws, np.array([3.0, 5.0]), np.array([0.5, 0.3]))
        assert 3 * p[0] + 5 * p[1] == pytest.approx(3.0)
        hits += p[0]
    assert hits / n == pytest.approx(0.5, abs=0.03)


# ---------------------------------------------------------------- 10


def test_preference(spark):
    schema = "pair_id long, turn long, role string, text string, extra int"
    chosen = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "good", 1), (2, 0, "user", "q", 1), (2, 1, None, None, 1), (3, 0, "user", "same", 1), (3, 0, "user", "same", 1), (None, 0, "user", "x", 1), (4, 0, "assistant", "only", 1)]
    rejected = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "bad", 1), (1, 2, "user", "more", 1), (2, 0, "user", "q", 1), (2, 1, None, None, 1), (3, 0, "user", "same", 1), (5, None, "user", "x", 1)]
    s = preference.preference_segments(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema))
    got = {r["pair_id"]: r for r in preference.assemble(s).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert one["chosen"] == "<|im_start|>assistant\ngood<|im_end|>\n" and one["rejected"].endswith("<|im_start|>user\nmore<|im_end|>\n")
    assert [one["chosen"][a:b] for a, b in one["chosen_mask"]] == ["good<|im_end|>"]
    assert [one["rejected"][a:b] for a, b in one["rejected_mask"]] == ["bad<|im_end|>"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[3]["prompt"].count("same") == 1
    assert got[4]["prompt"] == got[4]["rejected"] == "" and "only" in got[4]["chosen"]
    empty = spark.createDataFrame([], schema)
    assert preference.preference_segments(empty, empty).count() == 0


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    q = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in q.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(str(dict(zip(columns, r))[k]) for k in df.columns) for r in q.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.collect()) == want


CLASH = ["_id", "_score", "copies", "_copy", "_p", "_both", "piece_ids", "target", "score", "encoded", "predicted", "row", "number", "nth", "comp", "n", "quality_score", "toxic_score", "decoded", "held_out", "lang_pred", "size", "source_size", "kept_id", "row_id", "node", "text_hash", "slot", "block"]


def clashing(spark):
    rows = [(i, f"some words of text number {i % 40} here", "en", "ab"[i % 2], 3, *["own"] * len(CLASH)) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH))


def test_clashing_columns_in_operators(spark):
    d = clashing(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    replaced = {"score", "predicted", "held_out", "lang_pred", "piece_ids", "decoded"}
    for out in (
        toxicity.score_toxicity(d, toxicity.fit(d, labels)),
        quality_classifier.score_quality(d, quality_classifier.fit(d, labels)),
        language_id.predict_language(d, language_id.learn_samples(d)),
        pieces.encode_documents(d),
    ):
        row = out.first()
        assert out.count() == 120 and all(row[c] == "own" for c in CLASH if c not in replaced)
    assert ngram_join.jaccard_components(d).select("component_id").distinct().count() == 40
    assert mixing.mix(mixing.sized_documents(d)).count() == 120
    assert quality_rules.score_rules(d, quality_rules.bucket_weights(d, labels.select("doc_id"))).count() == 120
    assert token_rollup.changes(d, token_rollup.word_tokens(F.col("text")), "v", 1).count() == 120
    v = spark.createDataFrame([(i, [float(i), 1.0], "own", "own") for i in range(9)], "vec_id long, embedding array<double>, slot string, v string")
    p = kdtree.integer_points(v)
    assert kdtree.top_k(p, p, 2).count() == 18


def test_clashing_columns_in_stages(spark):
    d = clashing(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        rows = out.collect()
        assert out.columns == d.columns and all(r[c] == "own" for r in rows for c in CLASH), name
        assert len(rows) == 40 if "jaccard" in name else rows
    assert corpus_pipeline.encode_pieces(spark, d, SF).filter("lossless").count() == 120


def test_stages_with_odd_rows(spark):
    """Null ids, repeated ids and rows, null, empty and very long texts, empty tables."""
    base = "doc_id long, text string, lang string, source string, n_chars long"
    a, b = "the quick brown fox jumps over the lazy dog", "an altogether different text of several words"
    rows = [(3, a, "x", "s", 1), (5, a, "x", "s", 1), (5, b, "x", "s", 1), (None, "nothing like the others at all in here", "x", None, 1)]
    rows += [(None, "copies of a row without any id", "x", "s", k) for k in (2, 1, 1)] + [(None, None, None, None, None)] * 2 + [(8, " ", "x", "s", 1), (9, "word " * 200_000, "x", "s", 1)]
    d = spark.createDataFrame(rows, base)
    kept = sorted(corpus_pipeline.drop_near_duplicates(spark, d, SF).collect(), key=str)
    want = [rows[0], rows[2], rows[3], rows[5], rows[7], rows[8], rows[9], rows[10]]
    assert [tuple(r) for r in kept] == sorted(want, key=lambda r: str(d.sparkSession.createDataFrame([r], base).first()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), SF).count() == 0, name
        assert stage(spark, d, SF).count() <= 2 * len(rows), name
    many = spark.createDataFrame([(None, f"{i} " + "w " * (i % 7), "x", "st"[i % 2], 1) for i in range(4000)], base)
    taken = corpus_pipeline.mix_sources(spark, many, SF)
    got = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    sizes = {r["source"]: r["n"] for r in many.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert all(abs(got[s] - t) <= 7 for s, t in brute_targets(sizes).items())


def test_scratch(spark, monkeypatch):
    from framesift.llm import common

    with common.scratch_scope(spark) as kept:
        spent, result = common.cut(spark.range(3), "spent"), common.cut(spark.range(4), "result")
        kept.append(result)
    assert result.count() == 4
    with pytest.raises(Exception, match="(?i)exist"):
        spent.count()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "256m")
    common.small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == common.ARROW_BYTES
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    common.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master, applicationId = "local-cluster[2,1,1024]", "x"

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_root(Cluster)


def test_pipeline(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    d = source
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, d = d, stage(spark, d, SF).cache()
        assert d.columns == source.columns
        assert d.exceptAll(before.unionByName(before)).count() == 0  # only rows that came in, twice at most
        seen[name] = d.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, source, SF)
    rows = [(r["doc_id"], r["text"]) for r in source.collect()]
    groups = {c for (_, c) in brute_components(rows)}
    assert {r["doc_id"] for r in kept.collect()} == groups
    out = corpus_pipeline.encode_pieces(spark, d, SF)
    assert out.filter("not lossless").count() == 0 and out.count() == seen["mixing sources"]
