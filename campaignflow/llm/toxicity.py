"""Toxicity scores from a convolutional classifier of texts, trained in numpy, with thresholds by language.

A word's embedding is the mean of the hashed rows of the word and of its runs of GRAM bytes, so that words never seen share
what they have in common with known ones. Filters of several widths run over the words of a text; the largest answer of
each filter over the whole text, bent at zero, feeds a logistic unit. Only the windows that win the maximum have a gradient.
Thresholds are set on rows kept from training, one for each language as n-gram filters guess it from the text, and scores
are shifted so that each language's threshold stands at THRESHOLD.

All labelled rows that are not held out are learned from, whole: they are dealt to shards by hash, every shard trains on all
its rows from the same weights, and the weights are averaged, as often as there are epochs. Every document is scored over all
its words, in pieces of PIECE words, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignflow.llm import common as c
from campaignflow.llm import language

#: Labelled rows and bytes of a shard, about: what one task holds while it trains.
SHARD_ROWS, SHARD_BYTES = 4000, 32_000_000
#: Calibration rows of each label that a language needs for a threshold of its own; their logits are counted in bins of 1 / BINS.
LEAST_ROWS, BINS, WIDEST = 5, 256, 64
BUCKETS, DIM, GRAM, WIDTHS, FILTERS = 1 << 14, 12, 4, (1, 2, 3), 16
#: While training, each window is passed over with probability DROP, so that no single word explains a text by itself.
#: Where all rows are one shard, it passes over them until LEAST_STEPS are done.
BATCH, EPOCHS, LEAST_STEPS, RATE, DECAY, DROP = 32, 3, 600, 0.02, 0.02, 0.5
PIECE, BATCH_BYTES = 1 << 17, 1 << 20
#: The embeddings travel in so many pieces, the other weights in one more.
PIECES = 8
THRESHOLD = 0.3
FOLDS, FOLD, CALIBRATION = 4, 2, 4


class Words:
    """The words of some texts: ``word`` (number in the vocabulary) and ``text`` of each, and the buckets of each vocabulary word."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray):
        self.text = text
        names, first, self.word = np.unique(c.word_hashes(data, begin, end, lower=True), return_index=True, return_inverse=True)
        begin, size = begin[first], (end - begin)[first]
        # Words one after another behind one space each; a run of GRAM bytes starts at the space, or at any byte with GRAM - 1 more in the word.
        starts = np.concatenate([[0], np.cumsum(size + 1)])
        row = np.full(starts[-1] + GRAM, 32, np.uint8)
        nth = np.repeat(np.arange(len(size)), size)
        inside = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
        row[starts[nth] + 1 + inside] = c.LOWER[data[begin[nth] + inside]]
        runs = np.maximum(size + 2 - GRAM, 0)
        owner = np.repeat(np.arange(len(size)), runs)
        at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        value = np.zeros(len(at), np.uint64)
        for i in range(GRAM):
            value = value << np.uint64(8) | row[at + i].astype(np.uint64)
        self.count = runs + 1
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.bucket = np.empty(self.start[-1], np.int32)
        self.bucket[self.start[:-1]] = (names >> np.uint64(40)) % np.uint64(BUCKETS)
        rest = np.ones(len(self.bucket), bool)
        rest[self.start[:-1]] = False
        self.bucket[rest] = c.mixed(value + np.uint64(1)) >> np.uint64(40) & np.uint64(BUCKETS - 1)

    def buckets_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of some vocabulary words, one after another, and where each word's begin."""
        count = self.count[words]
        begin = np.cumsum(count) - count
        return self.bucket[np.arange(count.sum()) - np.repeat(begin, count) + np.repeat(self.start[words], count)], begin


class Network:
    """Embeddings, filters and the logistic unit."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.rows = random.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [random.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = random.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def embedded(self, words: Words, some: np.ndarray) -> np.ndarray:
        bucket, begin = words.buckets_of(some)
        return np.add.reduceat(self.rows[bucket], begin) / words.count[some][:, None].astype(np.float32)

    def answers(self, words: Words, n: int) -> np.ndarray:
        """What each filter says to the windows that begin at the first ``n`` words; windows end with their text."""
        vocabulary = np.add.reduceat(self.rows[words.bucket], words.start[:-1]) / words.count[:, None].astype(np.float32)
        more = n + max(WIDTHS) - 1
        x, text = np.zeros((more, DIM), np.float32), np.full(more, -1, np.int64)
        known = min(more, len(words.word))
        x[:known], text[:known] = vocabulary[words.word[:known]], words.text[:known]
        same = [x[k:k + n] * (text[k:k + n] == text[:n])[:, None] for k in range(max(WIDTHS))]
        return np.concatenate([sum(same[k] @ f[k] for k in range(len(f))) for f in self.filters], axis=1)

    def pooled(self, words: Words, n: int, n_texts: int, dropped: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest answer of each filter in each text to windows that begin at the first ``n`` words; -inf without any.

        Where some are ``dropped`` (one flag a window), as in training, also where the winning windows begin, else None.
        """
        best = np.full((n_texts, len(self.bias)), -np.inf, np.float32)
        where = None if dropped is None else np.full(best.shape, -1, np.int64)
        if n:
            said, text = self.answers(words, n), words.text[:n]
            if dropped is not None:
                said[dropped] = -np.inf
            begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            best[text[begin]] = np.maximum.reduceat(said, begin)
            if dropped is not None:
                at, column = np.nonzero((said == best[text]) & ~dropped[:, None])
                # Written from the last to the first, so that the first of equal answers stays.
                where[text[at[::-1]], column[::-1]] = at[::-1]
        return best, where

    def logits(self, texts: pa.Array) -> np.ndarray:
        """Of whole texts, in pieces of PIECE words; a piece knows the words after it that its last windows need."""
        data, offsets = c.text_buffer(texts)
        begin, end, first = c.word_spans(data, offsets, c.PUNCT_BYTES)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        best = np.full((len(texts), len(self.bias)), -np.inf, np.float32)
        for at in range(0, len(begin), PIECE):
            to = min(at + PIECE, len(begin))
            piece = slice(at, to + max(WIDTHS) - 1)
            low, high = text[at], text[to - 1] + 1
            words = Words(data, begin[piece], end[piece], text[piece] - low)
            best[low:high] = np.maximum(best[low:high], self.pooled(words, to - at, high - low)[0])
        return (np.maximum(best + self.bias, 0) @ self.out + self.base[0]).astype(np.float64)

    def winners(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, n_texts: int, dropped: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
        """What ``pooled`` finds in texts of any length, in pieces of PIECE words, and the words of the winning windows alone."""
        best = np.full((n_texts, len(self.bias)), -np.inf, np.float32)
        where = np.full(best.shape, -1, np.int64)
        for at in range(0, len(begin), PIECE):
            to = min(at + PIECE, len(begin))
            piece = slice(at, to + max(WIDTHS) - 1)
            low, high = text[at], text[to - 1] + 1
            some, place = self.pooled(Words(data, begin[piece], end[piece], text[piece] - low), to - at, high - low, dropped[at:to])
            better = some > best[low:high]
            best[low:high][better], where[low:high][better] = some[better], place[better] + at
        starts = np.unique(where[where >= 0])
        at = (starts[:, None] + np.arange(max(WIDTHS))).ravel()
        inside = at < len(begin)
        at = np.minimum(at, max(len(begin) - 1, 0))
        # What lies behind the end of a window's text belongs to no text.
        own = np.where(inside & (text[at] == np.repeat(text[starts], max(WIDTHS))), text[at], -1)
        return Words(data, begin[at], end[at], own), best, np.where(where >= 0, np.searchsorted(starts, where) * max(WIDTHS), -1)

    def gradients(self, words: Words, labels: np.ndarray, dropped: np.ndarray, found: tuple | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the mean log loss: of the dense parameters (in the order of ``dense``), the touched rows, and theirs.

        ``found``: largest answers and where their windows begin in ``words``, unless these are all words of the texts.
        """
        n = len(labels)
        best, where = found or self.pooled(words, len(words.word), n, dropped)
        hidden = np.maximum(best + self.bias, 0)
        error = ((1 / (1 + np.exp(-np.clip(hidden @ self.out + self.base[0], -30, 30))) - labels) / n).astype(np.float32)
        back = error[:, None] * self.out * (hidden > 0)
        text, column = np.nonzero(back)
        value, start = back[text, column], where[text, column]
        filters = [np.zeros_like(f) for f in self.filters]
        touched, pulls = [], []
        for w, f, g in zip(range(len(WIDTHS)), self.filters, filters, strict=True):
            mine = column // FILTERS == w
            v, s, t, col = value[mine], start[mine], text[mine], column[mine] % FILTERS
            for k in range(len(f)):
                at = s + k
                inside = (at < len(words.word)) & (words.text[np.minimum(at, len(words.word) - 1)] == t)
                word = words.word[at[inside]]
                some, index = np.unique(word, return_inverse=True)
                if len(some):
                    np.add.at(g[k].T, col[inside], v[inside][:, None] * self.embedded(words, some)[index])
                    touched.append(word)
                    pulls.append(v[inside][:, None] * f[k][:, col[inside]].T)
        dense = [*filters, back.sum(axis=0), error @ hidden, error.sum(keepdims=True)]
        if not touched:
            return dense, np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)
        word, pull = np.concatenate(touched), np.concatenate(pulls)
        bucket, _ = words.buckets_of(word)
        per_bucket = np.repeat(pull / words.count[word][:, None], words.count[word], axis=0)
        rows, index = np.unique(bucket, return_inverse=True)
        total = np.zeros((len(rows), DIM), np.float32)
        np.add.at(total, index, per_bucket.astype(np.float32))
        return dense, rows, total

    @property
    def dense(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.base]

    def set(self, rows: np.ndarray, dense: list[np.ndarray]):
        self.rows, self.filters, (self.bias, self.out, self.base) = rows, dense[:len(WIDTHS)], dense[len(WIDTHS):]


def words_of(texts: pa.Array) -> Words:
    data, offsets = c.text_buffer(texts)
    begin, end, first = c.word_spans(data, offsets, c.PUNCT_BYTES)
    return Words(data, begin, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)))


def batches_of(order: np.ndarray, sizes: np.ndarray):
    """``order`` in batches of BATCH texts, or fewer where they are long."""
    at = 0
    while at < len(order):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[order[at:at + BATCH]]), BATCH_BYTES, "right")))
        yield order[at:to]
        at = to


def trained(net: Network, texts: pa.Array, labels: np.ndarray, seed: list[int], passes: int | None = None) -> tuple[int, np.ndarray]:
    """Trains ``net`` by Adam on whole texts in shuffled batches; how many steps there were, and how many touched each embedding.

    Without ``passes``, EPOCHS, or as many as LEAST_STEPS take.
    """
    random = np.random.default_rng(seed)
    passes = passes or max(EPOCHS, -(-LEAST_STEPS // -(-len(texts) // BATCH)))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in [*net.dense, net.rows]]
    sizes, step, touched = np.diff(c.text_buffer(texts)[1]), 0, np.zeros(BUCKETS, np.int64)
    for _ in range(passes):
        for batch in batches_of(random.permutation(len(texts)), sizes):
            data, offsets = c.text_buffer(texts.take(pa.array(batch)))
            begin, end, first = c.word_spans(data, offsets, c.PUNCT_BYTES)
            text, dropped = np.repeat(np.arange(len(batch)), np.diff(first)), random.random(len(begin)) < DROP
            if len(begin) <= PIECE:
                words, found = Words(data, begin, end, text), None
            else:
                words, *found = net.winners(data, begin, end, text, len(batch), dropped)
            dense, rows, pull = net.gradients(words, labels[batch], dropped, found)
            step += 1
            touched[rows] += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v) in zip([*net.dense, net.rows], [*dense, pull], moments, strict=True):
                at = rows if p is net.rows else slice(None)
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.999 * v[at] + 0.001 * g * g
                p[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-6) + RATE * DECAY * p[at]
    return step, touched


AVERAGED = "part int, shard int, weights binary, n binary"


def weight_rows(part: int, shard: int, weights: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())],
        names=["part", "shard", "weights", "n"])


def shard_weights(net: Network, shard: int, steps: int, touched: np.ndarray):
    """The embeddings in PIECES, each with the steps that touched it, and the other weights with all steps."""
    for part, (weights, n) in enumerate(zip(np.array_split(net.rows, PIECES), np.array_split(touched, PIECES), strict=True)):
        yield weight_rows(part, shard, weights, n)
    yield weight_rows(PIECES, shard, np.concatenate([p.ravel() for p in net.dense])[None], np.array([steps], np.int64))


def averaged(batches):
    """The mean of each piece that a partition holds, by the steps of the shards; what none has touched stays as it began."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, _, raw, times in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            n = np.frombuffer(times, np.int64)
            weights = np.frombuffer(raw, np.float32).reshape(len(n), -1).astype(np.float64)
            if part not in total:
                total[part] = [weights * n[:, None], n.copy(), weights]
            else:
                total[part][0] += weights * n[:, None]
                total[part][1] += n
    for part, (weights, n, begin) in total.items():
        yield weight_rows(part, 0, np.where(n[:, None] > 0, weights / np.maximum(n, 1)[:, None], begin).astype(np.float32), n)


def fitted(rows: DataFrame, shards: int) -> Network:
    """A network trained on all ``rows`` (text, toxic, shard), which stand together by shard: in each epoch every shard trains
    from the same weights and the weights are averaged. A single shard needs no averaging and takes all its epochs at once."""
    spark, net = rows.sparkSession, Network()
    for epoch in range(EPOCHS if shards > 1 else 1):
        shared = spark.sparkContext.broadcast((net.rows, net.dense))  # less than a megabyte

        def run(batches, shared=shared, epoch=epoch):
            def learn(texts, labels, shard):
                own, (begin, dense) = Network(), shared.value
                own.set(begin.copy(), [p.copy() for p in dense])
                texts = pa.concat_arrays(texts)
                return shard_weights(own, shard, *trained(own, texts, np.concatenate(labels), [11, epoch, shard], 1 if shards > 1 else None))

            now, texts, labels = None, [], []
            for batch in batches:
                shard = batch.column(2).to_numpy(zero_copy_only=False)
                cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else np.zeros(1, int)
                for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if shard[at] != now and texts:
                        yield from learn(texts, labels, now)
                        texts, labels = [], []
                    now = int(shard[at])
                    texts.append(batch.column(0).slice(at, to - at).cast(pa.large_string()))
                    labels.append(batch.column(1).slice(at, to - at).to_numpy(zero_copy_only=False).astype(np.float32))
            if texts:
                yield from learn(texts, labels, now)

        # Sums in the order of the shards, so that runs agree; the weights reach the driver once, in PIECES + 1 pieces.
        moved = rows.select("text", "toxic", "shard").mapInArrow(run, AVERAGED).repartition(PIECES + 1, "part").sortWithinPartitions("part", "shard")
        found = sorted(moved.mapInArrow(averaged, AVERAGED).collect(), key=lambda r: r["part"])
        shared.unpersist()
        flat, dense, at = np.frombuffer(found[-1]["weights"], np.float32), [], 0
        for p in net.dense:
            dense.append(flat[at:at + p.size].reshape(p.shape).copy())
            at += p.size
        net.set(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in found[:-1]]).reshape(BUCKETS, DIM), dense)
    return net


def guess(filters: language.Filters, texts: pa.Array) -> np.ndarray:
    """The number of each text's language; -1 where no filter holds any of its n-grams."""
    data, offsets = c.text_buffer(texts)
    out = [np.zeros(0, np.int64)]
    for at, to in language.slices(offsets):
        value, text = language.grams(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        counts = filters.counts(value, text, to - at) if filters.langs else np.zeros((to - at, 1))
        out.append(np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), -1))
    return np.concatenate(out)


def best_threshold(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The logit, half way between two different neighbours, from which calling label 1 gives the best F1; the lowest of equal ones."""
    order = np.argsort(logit, kind="stable")
    x, y, w = logit[order], label[order], weight[order]
    hits = np.cumsum((y * w)[::-1])[::-1]
    f1 = 2 * hits / (np.cumsum(w[::-1])[::-1] + (y * w).sum())
    at = int(np.where(np.append(True, x[1:] != x[:-1]), f1, -1.0).argmax())
    return float((x[at - 1] + x[at]) / 2 if at else x[0] - 1)


class Classifier:
    """Network, language filters and thresholds; the last threshold is for texts of no known language."""

    def __init__(self, network: Network, filters: language.Filters, thresholds: np.ndarray):
        self.network, self.filters, self.thresholds = network, filters, thresholds

    def scores(self, texts: pa.Array) -> np.ndarray:
        shift = self.thresholds[guess(self.filters, texts)] - np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.network.logits(texts) - shift, -700, 700)))


def fitted_thresholds(rows: DataFrame, network: Network, filters: language.Filters) -> np.ndarray:
    """Threshold of each language and, last, of all together, from the logits of all ``rows`` (text, toxic), counted by bin."""
    shared = rows.sparkSession.sparkContext.broadcast((network, filters))

    def run(batches):
        network, filters = shared.value
        for batch in batches:
            texts = batch.column(0)
            place = np.floor(np.clip(network.logits(texts), -WIDEST, WIDEST) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(guess(filters, texts).astype(np.int32)), pa.array(place), batch.column(1)], names=["lang", "place", "toxic"])

    # A row per language, bin and label at most.
    counts = rows.select("text", "toxic").mapInArrow(run, "lang int, place int, toxic int").groupBy("lang", "place", "toxic").agg(F.count(F.lit(1)).alias("n"))
    own, place, y, n = (np.array(x) for x in zip(*sorted(tuple(r) for r in counts.collect()), strict=True))
    logit = (place + 0.5) / BINS
    thresholds = np.full(len(filters.langs) + 1, best_threshold(logit, y, n))
    for i in range(len(filters.langs)):
        mine = own == i
        if min(n[mine & (y == 1)].sum(), n[mine & (y == 0)].sum()) >= LEAST_ROWS:
            thresholds[i] = best_threshold(logit[mine], y[mine], n[mine])
    return thresholds


class Constant:
    """Where the labelled rows have one label or none, every text scores the share of label 1 among them (0 without any)."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.full(len(texts), self.share)


def labelled(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[int]]:
    """All training rows (packed, lang, toxic, place, kept), where ``kept`` rows set thresholds and never train; and the rows of each label."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("id IS NOT NULL AND toxic IN (0, 1)").where(~language.held_out(F.col("id"), FOLDS, FOLD)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = c.packed_texts(training_texts(documents))
    place = F.xxhash64("id", F.lit("sample"))
    # Both sides are dealt by id at any size, so that what is shuffled grows with the documents and no faster.
    found = texts.join(known.hint("merge"), "id").select("packed", "lang", "toxic", place.alias("place"), (F.pmod(F.shiftright(place, 8), F.lit(CALIBRATION)) == 0).alias("kept"))
    return found, [counts.get(0, 0), counts.get(1, 0)]


def training_texts(documents: DataFrame) -> DataFrame:
    ident = F.col("doc_id").cast("long")
    return documents.select(ident.alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~language.held_out(F.col("id"), FOLDS, FOLD))


def unpacked(batches):
    """Rows of ``labelled`` and their shard with the text itself."""
    for batch in batches:
        texts = pa.array(c.unpacked_texts(batch.column("packed")), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([texts, *(batch.column(n) for n in ("lang", "toxic", "kept", "shard"))], names=["text", "lang", "toxic", "kept", "shard"])


def learned(documents: DataFrame, labels: DataFrame):
    """The classifier, fitted on all labelled rows that are not held out."""
    found, n = labelled(documents, labels)
    if all(n):
        size = training_texts(documents).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(1, -(-sum(n) // SHARD_ROWS), -(-size // SHARD_BYTES))
        dealt = found.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int"))
        # A file holds whole shards in one row group, so that a task reads whole shards.
        ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "place", "packed")
        rows = c.written(ordered.mapInArrow(unpacked, "text string, lang string, toxic int, kept boolean, shard int"), "labelled", "zstd")
        seen = {(r["kept"], r["toxic"]) for r in rows.select("kept", "toxic").distinct().collect()}
        if len({toxic for _, toxic in seen}) == 2:
            apart = len(seen) == 4
            train, held = (rows.where("NOT kept"), rows.where("kept")) if apart else (rows, rows)
            network = fitted(train, shards)
            filters = language.learn(train)
            model = Classifier(network, filters, fitted_thresholds(held, network, filters))
            c.deleted(rows)
            return model
    return Constant(n[1] / sum(n) if sum(n) else 0.0)


def scored(documents: DataFrame, model) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, score, predicted, over all words of its text; null is the empty text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few megabytes, whatever the corpus
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), language.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        own = shared.value
        for batch in batches:
            score = own.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classified(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``scored`` for all ``documents``, learned from the labelled rows that are not held out.

    ``labels`` (doc_id, toxic) marks some documents; null and other marks are ignored, of several marks of one id the
    largest counts. With no marks of one kind, every score is the share of 1 among the marks, 0 without any. Repeated
    documents score alike, empty and null texts as texts without words; other columns are ignored; no documents, no rows.
    """
    return scored(documents, learned(documents, labels))
