"""Vector codes against a plain computation that compares every part with every entry."""

import collections
import hashlib
import math

import numpy as np
import pytest

from campaignflow.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, whole string, codes string, error string, p int"


def plain(rows):
    kept = [(v, l, [max(-2**26, min(2**26, math.floor(1024 * x))) if abs(1024 * x) < 2**40 else int(math.copysign(2**26, x)) for x in e]) for v, e, l in rows
            if e and len(e) % 4 == 0 and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // 4
    parts = [[r[2][p * width:(p + 1) * width] for r in kept] for p in range(4)]
    books = [own[:256] for own in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for turn in range(5):
        picks = [[nearest(x, book) for x in own] for own, book in zip(parts, books)]
        if turn == 4:
            break
        for p in range(4):
            members = collections.defaultdict(list)
            for x, (_, i) in zip(parts[p], picks[p]):
                members[i].append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*members[i])] if i in members else e for i, e in enumerate(books[p])]
    errors = [sum(picks[p][i][0] for p in range(4)) for i in range(len(kept))]
    by_label = collections.Counter()
    for r, e in zip(kept, errors):
        by_label[r[1]] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{picks[p][i][1]:02x}" for p in range(4)), errors[i], by_label[r[1]], digest) for i, r in enumerate(kept)]


def vectors(case):
    rng = np.random.default_rng(3)
    scale = {"usual": 0.3, "wide": 300.0, "huge": 1e6, "few": 0.3, "ties": 0.002}[case]
    n, length = (40, 8) if case == "few" else (700, 8)
    rows = [(i, (rng.normal(size=length) * scale).tolist(), [0, 1, None][i % 3]) for i in range(n)]
    rows += [rows[5], rows[5], (7, rows[9][1], 1), (None, rows[3][1], None), (900, None, 1), (901, [], 1), (902, [0.5] * 6, 1), (903, [0.5] * 12, 1),
             (904, [None] + [0.1] * 7, 1), (905, [math.nan] + [0.1] * 7, 1), (906, [math.inf] + [0.1] * 7, 1), (-5, [0.25] * 8, 0)]
    return rows


@pytest.mark.parametrize("case", ["usual", "wide", "huge", "few", "ties"])
def test_codes(spark, case, monkeypatch):
    monkeypatch.setattr(vector_codes, "SLICE_ROWS", 300)
    rows = vectors(case)
    df = spark.createDataFrame([(*r, "w", "c", "e", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in vector_codes.coded(df).collect()]
    assert collections.Counter(got) == collections.Counter(plain(rows))


def test_number_types_and_nothing_to_code(spark):
    assert [vector_codes.number_type(x, 16) for x in (500, 1 << 20, 1 << 26)] == [np.float32, np.float64, np.int64]
    assert vector_codes.coded(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes.coded(spark.createDataFrame([(1, None, 1, "", "", "", 1)], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_balls_skip_only_what_cannot_win():
    rng = np.random.default_rng(1)
    rows, entries = rng.integers(-30, 30, (3000, 3)), rng.integers(-30, 30, (64, 3))
    entries[10], entries[20] = entries[40], entries[3]
    balls = vector_codes.Balls(entries)
    far = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    code, best = balls.moved(rows, rng.integers(0, 64, 3000), np.float64)
    assert np.array_equal(code, far.argmin(axis=1)) and np.array_equal(best, far.min(axis=1))
