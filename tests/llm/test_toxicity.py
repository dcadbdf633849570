"""The convolutional classifier against a plain forward pass, numeric gradients and held-out accuracy."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from campaignflow.llm import common, toxicity

DOCS = "doc_id long, text string, lang string, source string, toxic int, place long, id long, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["", None, "One two, three: one TWO 'é'", "a", "b c", "x" * 300 + " y", " ".join(f"w{i % 37}" for i in range(400)), "née café 日本語 naïve", "..."]


def buckets(word: str) -> list[int]:
    raw = word.encode()
    name = common.word_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]
    out = [int(name >> np.uint64(40)) % toxicity.BUCKETS]
    row = b" " + raw
    for i in range(len(row) - toxicity.GRAM + 1):
        value = np.array([int.from_bytes(row[i:i + toxicity.GRAM], "big") + 1], np.uint64)
        out.append(int(common.mixed(value)[0] >> np.uint64(40)) & toxicity.BUCKETS - 1)
    return out


def plain_logit(net, text) -> float:
    x = [np.mean([net.rows[b] for b in buckets(w)], axis=0) for w in WORD.findall((text or "").translate(LOWER))]
    hidden = []
    for f in net.filters:
        for j in range(toxicity.FILTERS):
            said = [sum(float(x[i + k] @ f[k][:, j]) for k in range(len(f)) if i + k < len(x)) for i in range(len(x))]
            hidden.append(max(0.0, max(said) + net.bias[len(hidden)]) if said else 0.0)
    return float(np.dot(hidden, net.out) + net.base[0])


@pytest.fixture()
def net():
    out, rng = toxicity.Network(), np.random.default_rng(2)
    out.rows *= 10
    out.bias += rng.normal(0, 0.3, out.bias.shape).astype(np.float32)
    out.base += 0.25
    return out


@pytest.mark.parametrize("piece", [1 << 17, 7, 1])
def test_forward(net, piece, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    got = net.logits(pa.array(TEXTS, pa.string()))
    assert np.allclose(got, [plain_logit(net, t) for t in TEXTS], atol=1e-4)
    assert len(net.logits(pa.array([], pa.string()))) == 0


def test_gradients(net):
    words, labels = toxicity.words_of(pa.array(TEXTS[2:8], pa.string())), np.array([1, 0, 1, 0, 1, 0], np.float32)
    keep = np.zeros(len(words.word), bool)
    keep[::5] = True

    def loss():
        best, _ = net.pooled(words, len(words.word), 6, keep)
        z = (np.maximum(best + net.bias, 0) @ net.out + net.base[0]).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    dense, rows, pull = net.gradients(words, labels, keep)
    rng = np.random.default_rng(0)
    targets = [(p, g) for p, g in zip(net.dense, dense)] + [(net.rows, None)]
    for p, g in targets:
        if g is None:
            g = np.zeros_like(p)
            g[rows] = pull
        for at in map(tuple, np.argwhere(np.abs(g) > 1e-3)[rng.permutation(int((np.abs(g) > 1e-3).sum()))[:6]]):
            before, eps = p[at], 2e-3
            p[at] = before + eps
            up = loss()
            p[at] = before - eps
            slope = (up - loss()) / (2 * eps)
            p[at] = before
            assert math.isclose(slope, g[at], rel_tol=0.15, abs_tol=2e-3)


def test_threshold_is_the_best_f1():
    rng = np.random.default_rng(4)
    logit, label = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60)
    weight = np.where(label == 1, 1.0, 3.0)

    def f1(t):
        called = logit >= t
        return 2 * (weight * label)[called].sum() / (weight[called].sum() + (weight * label).sum())

    got = toxicity.best_threshold(logit, label, weight)
    assert f1(got) >= max(f1(t) for t in [*logit, logit.max() + 1]) - 1e-9 or len(set(logit)) < 60


@pytest.fixture(scope="module")
def corpus():
    rng, bad = random.Random(8), {"en": ["nasty", "foul"], "de": [f"schm{x}" for x in ("ier", "utz", "ach")]}
    docs, labels = [], []
    for i in range(900):
        lang = "en" if i % 3 else "de"
        stock = [f"{'th' if lang == 'en' else 'sch'}{rng.choice('aeiou')}{rng.choice('bdgkt')}{rng.choice('aeiou')}" for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            stock.insert(rng.randrange(len(stock)), rng.choice(bad[lang]) + ("" if lang == "en" else rng.choice("abcdefgh")))
        docs.append((i, " ".join(stock), lang if i % 11 else None, "s", 1 - toxic, 1, 2, 0.5))
        labels.append((i, 0, toxic if i % 7 else None, "x"))
    docs += [docs[3], docs[3], (10_000, None, None, None, None, None, None, None), (None, "", "en", None, None, None, None, None)]
    return docs, labels + [(None, 0, 1, "x"), (1, 0, 7, "x"), (50_000, 0, 1, "x")]


def test_held_out_accuracy_and_odd_rows(spark, corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 200)
    docs, labels = corpus
    frame, marks = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.classified(frame, marks).collect()
    assert len(got) == len(docs) and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in got)
    truth = {d[0]: 1 - d[4] for d in docs if d[4] is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    # A second run, and labels of the held-out rows turned round, change nothing.
    turned = [(i, q, None if t is None or i is None else (1 - t if t in (0, 1) and zlib.crc32(str(i).encode()) % 4 == 2 else t), x) for i, q, t, x in labels]
    again = toxicity.classified(frame.repartition(5), spark.createDataFrame(turned, "doc_id long, quality int, toxic int, text string")).collect()
    ranked = [sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in rows) for rows in (got, again)]
    assert [x[0] for x in ranked[0]] == [x[0] for x in ranked[1]] and np.allclose([x[1] for x in ranked[0]], [x[1] for x in ranked[1]], rtol=1e-3)


def test_without_labels_of_both_kinds(spark, corpus):
    docs = spark.createDataFrame(corpus[0][:10], DOCS)
    marks = spark.createDataFrame([(0, 1), (3, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.classified(docs, marks).collect()} == {1.0}
    assert {(r["score"], r["predicted"]) for r in toxicity.classified(docs, marks.limit(0)).collect()} == {(0.0, 0)}
    assert toxicity.classified(docs.limit(0), marks).collect() == []
    # Both kinds marked, but on documents that are not there.
    assert {r["score"] for r in toxicity.classified(docs, spark.createDataFrame([(70_000, 1), (70_003, 0), (70_004, 0)], "doc_id long, toxic int")).collect()} <= {0.0, 1 / 3, 1 / 2}


def test_all_labelled_rows_are_learned_from(spark):
    n = 4500
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id) AS text", "'en' AS lang")
    marks = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    rows, counts = toxicity.labelled(docs, marks)
    want = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    got = rows.select("packed", "toxic", "kept").toArrow()
    ids = [int(t[1:]) for t in common.unpacked_texts(got.column("packed"))]
    assert sorted(ids) == want and sum(counts) == len(want) and [i % 2 for i in ids] == got.column("toxic").to_pylist()
    assert 0.2 < sum(got.column("kept").to_pylist()) / len(ids) < 0.3


def test_shards_learn_together(spark, corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    monkeypatch.setattr(toxicity, "EPOCHS", 30)
    docs, labels = corpus
    got = toxicity.classified(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")).collect()
    truth = {d[0]: 1 - d[4] for d in docs if d[4] is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_long_texts_are_trained_in_pieces(net, monkeypatch):
    texts, labels = pa.array(TEXTS[2:8], pa.string()), np.array([1, 0, 1, 0, 1, 0], np.float32)
    words = toxicity.words_of(texts)
    dropped = np.random.default_rng(5).random(len(words.word)) < 0.3
    want, rows, pull = net.gradients(words, labels, dropped)
    data, offsets = common.text_buffer(texts)
    begin, end, _ = common.word_spans(data, offsets, common.PUNCT_BYTES)
    for piece in (1, 5, 100):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        some, *found = net.winners(data, begin, end, words.text, len(texts), dropped)
        got, own, other = net.gradients(some, labels, dropped, found)
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(got, want)) and np.array_equal(own, rows) and np.allclose(other, pull, atol=1e-5)
