"""The graphs of a training step and of scoring against numpy, and ids of words that are encoded once against whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest

from campaignflow.llm import attention_lm as lm
from campaignflow.llm import common as c

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SIGNS = [" ", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", "　", "​", "'s", "'", "don't",
         "A", "b", "Word", "É", "ß", "中文", "7", "42", "٣", "...", "-", "🙂", "\0", "é"]


def model():
    rng = np.random.default_rng(5)
    v = lm.Vocabulary(rng.integers(0, 50, 300).astype(float))
    flat = lm.start(len(v.symbol))
    flat += rng.normal(0, 0.3, len(flat)).astype(np.float32)
    return v, flat, [rng.integers(0, 300, n) for n in (0, 1, 15, 16, 17, 40, 100, 3000)]


def test_words_are_encoded_once_and_as_in_their_texts():
    rng = random.Random(3)
    texts = ["", " ", "x", *("".join(rng.choices(SIGNS, k=rng.randrange(1, 40))) for _ in range(3000)), "same words again " * 5000]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    own, sent = lm.Ids(RANKS), []
    want = [own.folded(r).tolist() for r in raw]
    encode, own.encoding = own.encoding, type("Counted", (), {
        "encode_to_numpy": lambda _, t: (sent.append(len(t)), encode.encode_to_numpy(t))[1], "encode_ordinary": lambda _, t: encode.encode_ordinary(t)})()
    found = lm.Encoded(own, data, offsets)
    assert [x.tolist() for x in found.lists(0, len(texts))] == want
    assert [x.tolist() for x in found.lists(7, 30)] == want[7:30]
    long = np.frombuffer(raw[-1], np.uint8)
    sent.clear()
    assert lm.Encoded(own, long, np.array([0, len(long)])).lists(0, 1)[0].tolist() == want[-1]
    assert sum(sent) < 100, "a word was encoded more than once"
    words = [w for t in raw for w in t.translate(lm.FOLD).split()]
    assert found.counts().sum() == len(words) and len(found.words) == len(set(words))


def test_graphs_agree_with_numpy():
    pytest.importorskip("onnxruntime")
    v, flat, lists = model()
    inputs, target, _ = lm.windows(lists, v.end, v.pad, v.begin)
    classes = np.where(target >= 0, v.of[np.maximum(target, 0)], -1)
    for large in (1, 3):
        p = lm.unpacked(flat * np.float32(large))
        for at in range(0, len(inputs), lm.BATCH):
            some = p, inputs[at:at + lm.BATCH], classes[at:at + lm.BATCH], v.pad
            for got, want in zip(lm.gradients(*some), lm.gradients(*some, graphs=False), strict=True):
                assert np.allclose(got, want, rtol=1e-3, atol=1e-4 * max(1, np.abs(want).max()))
        both = [lm.Scorer(flat * np.float32(large), v, graphs).scores(lists) for graphs in (True, False)]
        assert np.allclose(*both, rtol=1e-4) and np.isfinite(both[0]).all() and (both[0] < 0).all()


def test_graphs_stay_out_of_tasks_commands():
    from pyspark import cloudpickle

    v, flat, lists = model()
    lm.epoch_of([lists], flat, v, 0)
    assert len(cloudpickle.dumps(lm.epoch_of)) < 100_000


def test_texts_are_encoded_once_for_training_and_scores(spark, tmp_path, monkeypatch):
    """Held-out texts and others have the scores of the model on their own ids, in slices of any size; null and empty ones too."""
    texts = [None, "", "one\xa0two  Three", *(f"word {i} of {i % 7} texts" for i in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    kept = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda rows, v: kept.append((fit(rows, v, 1), v)) or kept[0][0])
    got = {r["doc_id"]: r["score"] for r in lm.scored(stored, RANKS).collect()}
    monkeypatch.setattr(lm, "TOGETHER_BYTES", 64)
    monkeypatch.setattr(lm, "SLICE_BYTES", 16)
    sliced = {r["doc_id"]: r["score"] for r in lm.scored(stored, RANKS).collect()}
    (flat, v), own = kept[0], lm.ids_of(RANKS)
    want = lm.Scorer(flat, v).scores([own.folded((t or "").encode()) for t in texts])
    assert len(got) == len(texts) and all(abs(got[i] - x) < 1e-4 * max(1, abs(x)) for i, x in enumerate(want))
    assert all(abs(got[i] - sliced[i]) < 1e-3 * max(1, abs(got[i])) for i in got)
