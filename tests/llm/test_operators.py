"""Each text operator against a plain computation on small documents with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from tokenizers import Tokenizer

import corpus_pipeline
from campaignflow.llm import attention_lm, decontaminate, jaccard, language, mixing, pii, quality, range_coder, substring_dedup, token_counts, token_files, tokens

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Input columns beside the contract's, with names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, size long, cls long, n_words long, kept boolean"


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice(['ba', 'Re', 'ño', 'zu'])}{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    item = prose(rng, 60)
    base = prose(rng, 120)
    near = base.split()
    near[50] = "other"
    out = [None, "", " \t\n", "one", "two words", base, base, " ".join(near), prose(rng, 40) + " " + item[:300] + " " + prose(rng, 30), item,
           prose(rng, 9000), "a b a b a b a b " * 30, "x" * 3000, "Écrit à la main — 日本語 😀\x1c end", "line\nline\n\nline\nother", "1 2 3 4 5 6 " * 12]
    out += [prose(rng, rng.randrange(1, 200)) for _ in range(20)] + [base.upper(), base + " tail"]
    return out, [item, " ".join(item.split()[:5]), None, "", "one", item, "two words"]


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", None, "s10"][i % 4 if i % 2 else 0], 1, 2, 3, 4, 5, 6, True) for i, t in enumerate(texts[0])]
    rows += [rows[5], (None, "null id here", None, None, None, None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("in") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def counted(got, want):
    assert collections.Counter(got) == collections.Counter(want)


def test_decontaminate(spark, docs, texts):
    bench = spark.createDataFrame(list(enumerate(texts[1])), "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = collections.defaultdict(set)
    for i, t in enumerate(texts[1]):
        w = word.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[j:j + n])].add(i)
    want = []
    for doc_id, t in rows_of(docs):
        w, hit, items = word.findall(t.translate(LOWER)), set(), set()
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in grams:
                    hit.update(range(j, j + n))
                    items |= grams[tuple(w[j:j + n])]
        names = ",".join(sorted(map(str, items)))
        want.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for broadcast_rows in (decontaminate.BROADCAST_ROWS, 0):
        decontaminate.BROADCAST_ROWS, before = broadcast_rows, decontaminate.BROADCAST_ROWS
        got = [tuple(r) for r in decontaminate.digest(decontaminate.contamination(docs, bench)).collect()]
        decontaminate.BROADCAST_ROWS = before
        counted(got, want)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(want)


@pytest.mark.parametrize("length", [35, 20, 70])
def test_substring_dedup(docs, length):
    own = [(d, t.encode().split()) for d, t in rows_of(docs)]
    seen = collections.Counter(tuple(w[i:i + length]) for _, w in own for i in range(len(w) - length + 1))
    want = []
    for d, w in own:
        gone = {p for i in range(len(w) - length + 1) if seen[tuple(w[i:i + length])] > 1 for p in range(i, i + length)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.without_repeats(docs, length, ("doc_id", "n_words", "n_removed", "kept_sha256")).collect()
    counted(map(tuple, got), want)


def test_places_and_names_pack():
    at = np.array([0, 3, 258, 259, 1000, 70000])
    assert np.array_equal(substring_dedup.unpack_places(substring_dedup.pack_places(at)), at)
    names = np.array([0, 2**48 - 1, 5], np.uint64)
    assert np.array_equal(substring_dedup.unpack_names(substring_dedup.pack_names(names, 6), 6), names)
    assert substring_dedup.levels(35) == [18, 35] and substring_dedup.levels(20) == [20] and substring_dedup.levels(70) == [18, 35, 70]


def test_token_files(spark, docs, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "ids"), JSON)
    got = token_files.read_tokens(spark, str(tmp_path / "ids"), with_ids=True).collect()
    tk = Tokenizer.from_file(JSON)
    tk.encode_special_tokens = True
    want = collections.Counter((d, tuple([*tk.encode(t, add_special_tokens=False).ids, 0])) for d, t in rows_of(docs))
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["n_tokens"]
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ordered[0] is None and ordered[1:] == sorted(ordered[1:])


def test_pieces_encode_like_whole_texts():
    rng, own = random.Random(1), tokens.Encoder(JSON)
    tk = Tokenizer.from_file(JSON)
    tk.encode_special_tokens = True
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", ",", "'s", "\x1c", "日", "😀", "̀", "\r", "<|endoftext|>"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for t, ids in zip(some, own.encode(some), strict=True):
        assert np.array_equal(np.frombuffer(ids, np.uint32), tk.encode(t, add_special_tokens=False).ids), repr(t)


@pytest.mark.parametrize("n", [0, 1, 1023, 1025, 9000, 40000])
def test_range_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.4, n) % 60000
    raw = range_coder.encode(ids)
    assert np.array_equal(range_coder.decode(raw), ids)
    size = range_coder.block_size(n)
    if n > 3 * size:
        assert np.array_equal(range_coder.decode(raw, [1, 2]), ids[size:3 * size])
        assert len(raw) < 2 * n
        damaged = bytearray(raw)
        damaged[-20] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode(bytes(damaged))


def test_mixing(docs):
    got = mixing.mixture(docs).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        assert r["size"] == 0 or r["taken"] <= 3 * r["size"]
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        free -= full
    target |= {s: level * weight[s] for s in free}
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], target[s]) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own) * (2 if s == "s0" else 1)
    copies = collections.Counter((r["doc_id"]) for r in mixing.mixed(docs).collect())
    assert sum(copies.values()) == sum(r["copies"] for r in got)
    counted(map(tuple, mixing.mixture(docs).collect()), map(tuple, got))


def test_language(spark, tmp_path):
    rng = random.Random(5)
    kinds = {"xa": "abcdeé", "yb": "pqrstü", "zc": "klmnoñ"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(3, 60))), k)
            for i in range(600) for k in [rng.choice(list(kinds))]]
    rows += [(1000, None, "xa"), (1001, "12 34 !", "yb"), (1002, "", None), (None, "abba", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in language.identified(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows if i is not None)
    held = [(got[i]["lang_pred"], k) for i, _, k in rows[:600] if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())


def test_token_counts(docs):
    tk = Tokenizer.from_file(JSON)
    tk.encode_special_tokens = True
    n = np.array([len(tk.encode(t, add_special_tokens=False).ids) for _, t in rows_of(docs)])
    table = token_counts.cumulative(token_counts.histogram(docs, RANKS)).cache()
    for r in table.collect():
        x = r["length"]
        assert (r["n_docs"], r["docs_over"], r["truncated_tokens"], r["total_tokens"]) == ((n == x).sum(), (n > x).sum(), np.minimum(n, x).sum(), n.sum())
    assert token_counts.at_limits(table, [1, 100, 10**6]) == [(x, np.minimum(n, x).sum(), (n > x).sum()) for x in (1, 100, 10**6)]
    assert token_counts.quantile(table, 0.5) == np.sort(n)[math.ceil(0.5 * len(n)) - 1]


def plain_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for p in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality(docs):
    table = quality.judged(docs)
    got = table.collect()
    counted([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got],
            [(d, *plain_measures(t)) for d, t in rows_of(docs)])
    assert all(r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5) for r in got)
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_estimation_finds_the_bad_group(spark):
    """The same estimation in plain Python gives the same posteriors, and two rules that fire together reject."""
    good, bad = {f"vote_{r.name}": 1 for r in quality.RULES}, {f"vote_{r.name}": 1 for r in quality.RULES}
    bad |= {"vote_symbols": -1, "vote_letters": -1}
    rows = [good] * 950 + [bad] * 50
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{n} tinyint" for n in good))
    trust = quality.estimate(df)
    share, reject = quality.BELIEF_GOOD, {n: (quality.BELIEF_GOOD_REJECTED, quality.BELIEF_BAD_REJECTED) for n in good}
    for _ in range(quality.ROUNDS):
        p = []
        for r in rows:
            x = math.log(share / (1 - share))
            for n, (g, b) in reject.items():
                x += math.log(g / b) if r[n] < 0 else math.log((1 - g) / (1 - b))
            p.append(1 / (1 + math.exp(-x)))
        prior = quality.BELIEF_SHARE * len(rows)
        share = (sum(p) + quality.BELIEF_GOOD * prior) / (len(rows) + prior)
        reject = {n: ((sum(q for q, r in zip(p, rows) if r[n] < 0) + quality.BELIEF_GOOD_REJECTED * prior) / (sum(p) + prior),
                      (sum(1 - q for q, r in zip(p, rows) if r[n] < 0) + quality.BELIEF_BAD_REJECTED * prior) / (len(p) - sum(p) + prior)) for n in good}
    assert math.isclose(trust.good, share, rel_tol=1e-6)
    assert math.isclose(trust.weight["symbols"][-1], math.log(reject["vote_symbols"][0] / reject["vote_symbols"][1]), rel_tol=1e-6)
    assert {round(x[0]) for x in df.select(trust.posterior()).distinct().collect()} == {0, 1}


def test_jaccard(docs):
    own = rows_of(docs)
    sets = []
    for _, t in own:
        w = t.translate(LOWER).encode().split()
        sets.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(own):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    want = [(d, len(sets[i]), smallest.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(own)]
    for short in (jaccard.SHORT_LIST, 0):
        jaccard.SHORT_LIST, before = short, jaccard.SHORT_LIST
        got = [tuple(r) for r in jaccard.digest(jaccard.joined(docs)).collect()]
        jaccard.SHORT_LIST = before
        counted(got, want)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    # One row of each component, its smallest doc_id (null last), and every row without shingles.
    parts = collections.defaultdict(list)
    for i, (d, _) in enumerate(own):
        parts[find(i) if sets[i] else ("empty", i)].append((d is None, d))
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(min(x, key=lambda y: (y[0], y[1] or 0))[1] for x in parts.values())


def test_jaccard_tables_have_no_row_per_pair(spark, tmp_path, monkeypatch):
    """Near copies of which few are linked: as many rows as there are texts, a few times, and all components."""
    rng = random.Random(12)
    base, some = prose(rng, 300).split(), []
    for i in range(400):
        words = list(some[-1] if i % 5 == 4 else base)
        for at in rng.sample(range(300), 1 if i % 5 == 4 else 4):
            words[at] = f"other{i}"
        some.append(words)
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(some)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    sets = [{tuple(w[j:j + 3]) for j in range(len(w) - 2)} for w in ([x.translate(LOWER) for x in t] for t in some)]
    smallest = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                low, high = sorted((smallest[i], smallest[j]))
                smallest = [low if x == high else x for x in smallest]
    assert 200 < len(set(smallest)) < 350
    written, rows = jaccard.c.written, collections.defaultdict(int)

    def counted_rows(df, name, *args):
        out = written(df, name, *args)
        rows[name] = max(rows[name], out.count())
        return out

    monkeypatch.setattr(jaccard.c, "written", counted_rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == dict(enumerate(smallest))
    assert max(rows[x] for x in ("pairs", "near", "links")) < 10 * len(some), dict(rows)


def test_jaccard_forests_of_blocks_connect_what_pairs_do():
    """Two lists in blocks, in batches that end inside groups: links between components, each block pair a forest, none missed."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 60, np.int64).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.choice((0.02, 0.08)), rng.integers(1, 1 << 62, 60).astype(np.uint64), base)) for _ in range(50)]
    lists, component = [range(0, 35), range(20, 50)], [i // 2 * 2 for i in range(50)]
    placed = sorted((100 + k, 200 + k, low, high, i % 3, i, component[i], len(sets[i])) for k, some in enumerate(lists) for i in some
                    for low in range(3) for high in range(low, 3) if i % 3 in (low, high))
    names = [x.split()[0] for x in jaccard.PLACED.split(", ")]
    table = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in placed], pa.schema([(n, pa.int32() if n in ("low", "high", "block") else pa.int64()) for n in names]))
    bits = [jaccard.bitmaps(np.zeros(len(x), np.int64), x, 1).tobytes() for x in sets]
    found = list(jaccard.possible_rows(table.append_column("bits", pa.array([bits[r[5]] for r in placed], pa.binary())).to_batches(7), 80))
    segments = []
    for r in pa.Table.from_batches(found).to_pylist():
        raw = np.ascontiguousarray(sets[r["cls"]].view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
        segments += [r | {"shingles": raw[:60]}, r | {"shingles": raw[60:]}]
    schema = pa.schema([*found[0].schema, ("shingles", pa.binary())])
    links = {x for b in jaccard.linking_rows(pa.Table.from_pylist(segments, schema).to_batches(11), 80) for x in zip(*(y.to_pylist() for y in b.columns), strict=True)}
    own = [set(x.tolist()) for x in sets]
    want = {(i, j) for some in lists for i in some for j in some
            if i < j and component[i] != component[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])}

    def parts(edges):
        of = list(component)
        for i, j in edges:
            of = [min(of[i], of[j]) if x in (of[i], of[j]) else x for x in of]
        return of

    assert 100 < len(want) and links < want and parts(links) == parts(want) and 1 < len(set(parts(want)))


def test_representatives_keep_unlinked_texts_of_one_id(spark, tmp_path):
    rng = random.Random(8)
    one, two, three = (prose(rng, 50) for _ in range(3))
    spark.createDataFrame([(5, one), (5, two), (6, three), (7, one), (5, two)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = jaccard.representatives(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(5, one), (5, two), (6, three)])


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["cls"]: r["component"] for r in jaccard.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_pii(spark, tmp_path):
    card = "4111 1111 1111 1111"
    some = ["mail a.b@c-d.example.org now a@b.c_d@e.fg", "ips 1.2.3.4.5.6.7.8 300.1.1.1 010.0.0.255", f"pay {card} or 4111111111111112", "call +49 (30) 123-4567 or +1 2",
            None, "", "😀 x@y.zz", "@" * 500 + "a" * 3000, "7" * 5000, *["secretname wrote joe@corp.example today"] * 3, "today is fine"]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in pii.digest(pii.spans(docs)).collect()}
    assert [got[i]["n_email"] for i in (0, 4, 5, 6, 7)] == [3, 0, 0, 1, 0] and [got[i]["n_ip"] for i in (1,)] == [3]
    assert got[2]["n_card"] == 1 and got[3]["n_phone"] == 1 and got[8]["n_card"] == 0 and got[6]["spans"] == "email:2:8"
    assert got[2]["base_sha256"] == hashlib.sha256(f"card:4:{4 + len(card)}".encode()).hexdigest()
    assert got[9]["spans"] == "term:0:10,term:11:16,email:17:33" and got[12]["spans"] == ""  # today is also elsewhere
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[9] == "<term> <term> <email> today" and clean[12] == "today is fine"


def test_attention_lm(docs):
    got = attention_lm.scored(docs, RANKS).collect()
    own = [(d, t.translate(LOWER).encode().split()) for d, t in rows_of(docs)]
    out = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in own}
    count = collections.Counter(x for d, w in own if not out[d] for x in [*w, None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter((d, out[d], len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [*w, None]), 5)) for d, w in own)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_attention_gradient_and_windows():
    rng = np.random.default_rng(0)
    v = attention_lm.Vocabulary(rng.integers(0, 50, 300).astype(float))
    lists = [rng.integers(0, 300, n) for n in (0, 1, 15, 16, 17, 40, 100)]
    inputs, target, text = attention_lm.windows(lists, v.end, v.end + 2, v.end + 1)
    symbols, classes = v.symbol[inputs], np.where(target >= 0, v.of[np.maximum(target, 0)], -1)
    assert (target >= 0).sum() == sum(len(x) + 1 for x in lists)
    flat = attention_lm.start().astype(float) + rng.normal(0, 0.1, len(attention_lm.start()))
    loss, g = attention_lm.gradient(flat, symbols, classes, v.pad)
    for j in rng.integers(0, len(flat), 15):
        step = np.zeros_like(flat)
        step[j] = 1e-5
        slope = (attention_lm.gradient(flat + step, symbols, classes, v.pad)[0] - attention_lm.gradient(flat - step, symbols, classes, v.pad)[0]) / 2e-5
        assert abs(slope - g[j]) < 1e-4 + 1e-2 * abs(slope)
    whole = -loss * (classes >= 0).sum() / math.log(10) + sum(v.within[x].sum() for x in lists)
    assert abs(attention_lm.Scorer(flat, v).scores(lists).sum() - whole) < 1e-2
    better = attention_lm.trained(flat.astype(np.float32), np.repeat(symbols, 20, 0), np.repeat(classes, 20, 0), v.pad)
    assert attention_lm.gradient(better, symbols, classes, v.pad)[0] < loss


def test_empty_tables(spark, empty, tmp_path):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(empty, bench).count() == 0
    assert substring_dedup.without_repeats(empty).count() == 0
    token_files.write_tokens(empty, str(tmp_path / "ids"), JSON)
    assert token_files.read_tokens(spark, str(tmp_path / "ids")).count() == 0
    assert mixing.mixture(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert language.identified(empty).count() == 0
    assert token_counts.cumulative(token_counts.histogram(empty, RANKS)).count() == 0
    assert quality.judged(empty).count() == 0 and quality.filtered(empty).count() == 0
    assert jaccard.joined(empty).count() == 0 and jaccard.representatives(empty).count() == 0
    assert pii.spans(empty).count() == 0
    assert attention_lm.scored(empty, RANKS).count() == 0


def test_pipeline_stages_chain(spark, docs, texts, tmp_path):
    """Stage by stage on each stage's own input, and the whole run once more."""
    spark.createDataFrame(list(enumerate(texts[1])), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, sizes = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        sizes.append(now.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4]
    counted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), map(tuple, now.collect()))


def test_attention_trains_on_every_id(spark):
    """Ids far into the only text are read, each by its own embedding; the windows of one epoch cover every id and the end."""
    ids = np.arange(1000)
    v = attention_lm.Vocabulary(np.ones(1100))
    adam, n = attention_lm.epoch_of([[ids], [ids[:5], ids[:0]]], attention_lm.start(len(v.symbol)), v, 0)
    assert n == math.ceil(1001 / 16) + 2 and (adam.read[:1000] > 0).all() and (adam.read[1000:1100] == 0).all()
    stored = spark.createDataFrame([(attention_lm.TEXT, 1, 1, ids.tolist()), (attention_lm.TEXT, 2, 1, [7, 8])], attention_lm.GATHERED).repartition(2)
    before, after = (attention_lm.unpacked(x)["embed"] for x in (attention_lm.start(len(v.symbol)), attention_lm.fit(stored, v, 1)))
    moved = (before != after).any(axis=1)
    assert moved[:1000].all() and not moved[1000:1100].any()


def test_pii_terms_of_whole_texts(spark, tmp_path):
    """A name far from the value discloses it, and is marked at each of its places, also in a text without the value."""
    rng = random.Random(4)
    far = [f"Mr. Quibbleton, {prose(rng, 60)} joe@corp.example {prose(rng, 60)} (quibbleton)" for _ in range(30)]
    some = [*far, "so quibbleton left", *[f"sunny {prose(rng, 30)}" for _ in range(30)]]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.digest(pii.spans(docs)).collect()}
    for i, t in enumerate(far):
        assert {"term:4:15", f"term:{len(t) - 12}:{len(t)}"} <= set(got[i])
    assert got[30] == ["term:3:13"] and got[31] == [""]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert not any("quibbleton" in t.lower() or "joe@" in t for t in clean.values()) and clean[30] == "so <term> left"


def test_pii_disclosing_against_plain_counts(spark, tmp_path):
    """Nothing is lost by what is left out before values and terms meet."""
    rng = random.Random(8)
    some = [" ".join(rng.choice([f"word{rng.randrange(40)}", f"rare{rng.randrange(400)}", f"m{rng.randrange(25)}@x.yz", "common", "a1"]) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    entity, term, joint = collections.Counter(), collections.Counter(), collections.Counter()
    for t in some:
        e, w = {x for x in t.split() if "@" in x}, {x for x in t.split() if "@" not in x and x != "a1"}
        entity.update(e)
        term.update(w)
        joint.update((x, y) for x in e for y in w)
    want = {y for (x, y), n in joint.items() if n >= 2 and math.log(n / term[y]) - math.log(entity[x] / 300) >= -0.95 * math.log(entity[x] / 300)}
    marked = {some[r["doc_id"]][int(a):int(b)] for r in pii.digest(pii.spans(spark.read.parquet(str(tmp_path / "d")))).collect()
              for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"}
    assert want and marked == want


def test_pipeline_jaccard_stage_against_all_pairs(spark, tmp_path):
    """The stage links five-word shingles from 80 %: appended text, one changed block, scattered changes."""
    rng = random.Random(6)
    some = []
    for _ in range(6):
        base = prose(rng, 300).split()
        scattered = list(base)
        for i in range(10, 300, 50):
            scattered[i] = "changed"
        block = base[:100] + prose(rng, 24).split() + base[124:]
        some += [base, base + prose(rng, rng.randrange(40, 90)).split(), block, scattered, prose(rng, 300).split()]
    some += [[], ["one"], ["one"], ["a", "b", "c", "d"], ["a", "b", "c", "e"]]
    rows = [(i, " ".join(w)) for i, w in enumerate(some)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ([x.translate(LOWER) for x in t] for t in some)]
    linked = {i: {j for j in range(len(sets)) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} | {i} for i in range(len(sets))}
    while True:
        wider = {i: set().union(*(linked[j] for j in own)) for i, own in linked.items()}
        if wider == linked:
            break
        linked = wider
    want = sorted(i for i, own in linked.items() if min(own) == i)
    assert len(want) < len(some) - 10
    docs = spark.read.parquet(str(tmp_path / "d"))
    for short in (jaccard.SHORT_LIST, 0):
        jaccard.SHORT_LIST, before = short, jaccard.SHORT_LIST
        kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
        jaccard.SHORT_LIST = before
        assert sorted(r["doc_id"] for r in kept) == want


def test_jaccard_rows_keep_their_numbers(spark, docs, monkeypatch):
    """File splits that change from job to job, as when executors come and go, change nothing."""
    want = sorted(map(str, jaccard.digest(jaccard.joined(docs)).collect()))
    kept = sorted(map(str, jaccard.representatives(docs).collect()))
    parquet, calls = DataFrameWriter.parquet, []

    def other_splits(self, *args, **kwargs):
        parquet(self, *args, **kwargs)
        calls.append(args)
        spark.conf.set("spark.sql.files.minPartitionNum", [1, 100][len(calls) % 2])

    monkeypatch.setattr(DataFrameWriter, "parquet", other_splits)
    try:
        assert sorted(map(str, jaccard.digest(jaccard.joined(docs)).collect())) == want
        assert sorted(map(str, jaccard.representatives(docs).collect())) == kept
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(calls) > 4


def test_token_files_hold_the_librarys_ids(spark, tmp_path):
    """Texts with and without the added token give the ids of an untouched tokenizer."""
    some = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>\n<|endoftext|>y z", "plain text  here", "<|endoftext>", None, ""]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    token_files.write_tokens(spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "ids"), JSON)
    tk = Tokenizer.from_file(JSON)
    want = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(some)}
    assert {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, str(tmp_path / "ids"), with_ids=True).collect()} == want
    assert want[0].count(50256) == 1


def test_common_words_go_to_the_model_alone():
    """Every common character beside others gives the library's ids, and units of them never take the library's whole call."""
    own, tk = tokens.Encoder(JSON), Tokenizer.from_file(JSON)
    tk.encode_special_tokens = True
    whole = []
    own.units._rest = whole.extend
    beside = ["", "a", " ", "1", "'", " a", "\n"]
    some = [f"{x}{c}{y}" for c in tokens._COMMON for x in beside for y in ("", "b", " b", "!", "s")] + ["don't  stop, café!\n\nx²y"]
    for t, ids in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)
    assert not whole
    own = tokens.Encoder(JSON)
    some = ["a\0b c", "\0", "Жя, ok", "日本 x", None, "", "a b", "x" * 5000]
    assert [np.frombuffer(ids, np.uint32).tolist() for ids in own.encode(some, about=3)] == [tk.encode(t or "", add_special_tokens=False).ids for t in some]


def test_blocks_of_a_full_segment_advance_together():
    """A segment of four million ids takes 2048 steps over as many blocks, and every id is coded."""
    n = token_files.SEGMENT_IDS
    assert range_coder.block_size(n) == 2048
    assert sum((end - begin) * k for begin, end, k in range_coder.strides(2048, n - 3 - 2047 * 2048, 2048)) == n - 3
    assert list(range_coder.strides(40, 5, 1)) == [(0, 5, 1)]
