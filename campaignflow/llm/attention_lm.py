"""Scores of texts under a causal self-attention model and under word counts.

The model reads the ids of a public byte-level BPE vocabulary, each with an embedding of its own. One layer of causal
self-attention predicts the class of the next id: classes hold ids of like frequency, the most frequent ones alone, and counts
over all training texts share a class's probability among its ids. It is trained in numpy on every id of every training text:
each partition runs Adam over all windows of its texts, and the weights are averaged between the epochs, weighted by windows; an
id's embedding is weighted by the times it was read. Windows of SPAN ids overlap so that each id is a target once, with
SPAN - STRIDE ids before it at least, where the text has them.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignflow.llm import common as c
from campaignflow.llm.attention_graph import Graphs, backward, forward
from campaignflow.llm.language import held_out

SPAN, STRIDE, WIDTH = 32, 16, 16
SINGLE, SHARED = 40, 22
#: Symbols of the 50k vocabulary: its ids, and the end, the begin and what is before a text.
SYMBOLS = 50_259
#: Pieces in which the embeddings of a partition are averaged.
SHARDS = 16
EPOCHS, BATCH, RATE = 3, 128, 0.01
#: Windows scored at a time.
WINDOWS_SCORED = 256
#: Words encoded in one call.
WORDS_AT_ONCE = 1 << 16
#: Ids that a task lays out at a time, and one text at least; windows are shuffled among them.
PIECE_IDS = 1 << 17
#: Words that make up at least this share of the training text are looked up in a broadcast table of 1 / share rows at
#: most; the others are joined.
FREQUENT_SHARE = 1e-6
SLICE_BYTES = 1 << 20
#: Bytes of text, and one text at least, whose different words are encoded together.
TOGETHER_BYTES = 1 << 22
NEGATIVE = np.float32(-1e9)

#: White space of the vocabulary's pattern that does not separate words here.
OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Lower case, and one kind of separator.
FOLD = bytes(32 if c.SPACE_BYTES[i] else int(c.LOWER[i]) for i in range(256))


class Ids:
    """Texts to ids with a vocabulary file of the tiktoken library."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def lengths(self, texts: list[str | None]) -> list[int]:
        return [len(self.encoding.encode_ordinary(t)) if t else 0 for t in texts]

    def folded(self, raw: bytes) -> np.ndarray:
        """Ids of the lower-cased words of a UTF-8 text, joined by one space."""
        words = raw.translate(FOLD).split()
        return self.encoding.encode_to_numpy(b" ".join(words).decode()).astype(np.int64) if words else np.zeros(0, np.int64)

    def units(self, words: list[bytes], before: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, each with ``before`` in front, one word after another, and how many each has. A word has no white space inside."""
        found = [np.zeros(0, np.uint32)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at:at + WORDS_AT_ONCE]
            found.append(self.encoding.encode_to_numpy(b"".join([before, (b"\n" + before).join(some), b"\n"]).decode()))
        ids = np.concatenate(found)
        (line_end,) = self.encoding.encode_ordinary("\n")
        inner = ids != line_end
        return ids[inner], np.diff(np.flatnonzero(~inner), prepend=-1) - 1


class Encoded:
    """Ids of the lower-cased words of many texts, each text's words joined by one space, as ``Ids.folded`` gives them.

    The pattern cuts before a space that has a visible character on each side, so a text's ids are those of its first word and
    of each other word with the space before it. Words are told apart by their hashes; of each one that differs the ids are found
    once. Texts with other white space are encoded whole.
    """

    def __init__(self, own: Ids, data: np.ndarray, offsets: np.ndarray):
        self.own, self.raw, self.offsets = own, data.tobytes(), offsets
        begin, end, self.first = c.word_spans(data, offsets, c.SPACE_BYTES)
        self.hashes = c.signed(c.word_hashes(data, begin, end, lower=True))
        coded = pa.array(self.hashes).dictionary_encode()
        self.words, self.which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        # The dictionary is in the order of first places.
        place = np.flatnonzero(np.diff(np.maximum.accumulate(self.which), prepend=-1))
        folded = self.raw.translate(FOLD)
        words = [folded[a:b] for a, b in zip(begin[place].tolist(), end[place].tolist(), strict=True)]
        odd = np.zeros(len(words), bool)
        if OTHER_SPACE.search(folded.decode()):
            odd = np.fromiter((bool(OTHER_SPACE.search(w.decode())) for w in words), bool, len(words))
            words = [b"-" if out else w for w, out in zip(words, odd.tolist(), strict=True)]
        self.whole = np.unique(np.searchsorted(self.first, np.flatnonzero(odd[self.which]), "right") - 1) if odd.any() else np.zeros(0, np.int64)
        starts = self.first[:-1][np.diff(self.first) > 0]
        leading, number = np.unique(self.which[starts], return_inverse=True)
        self.unit = self.which.astype(np.int64)
        self.unit[starts] = len(words) + number
        ids, size = zip(own.units(words, b" "), own.units([words[i] for i in leading.tolist()], b""), strict=True)
        self.ids, self.size = np.concatenate(ids), np.concatenate(size)
        self.begin = np.cumsum(self.size) - self.size

    def counts(self) -> np.ndarray:
        """How often each of ``words`` occurs."""
        return np.bincount(self.which, minlength=len(self.words))

    def lists(self, at: int, to: int) -> list[np.ndarray]:
        """The ids of each text from ``at`` to ``to``."""
        first = self.first[at:to + 1]
        unit = self.unit[first[0]:first[-1]]
        size = self.size[unit]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.begin[unit] - ends[:-1], size) + np.arange(ends[-1])]
        ends = ends[first - first[0]].tolist()
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in self.whole[(self.whole >= at) & (self.whole < to)].tolist():
            out[i - at] = self.own.folded(self.raw[self.offsets[i]:self.offsets[i + 1]])
        return out


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _IDS:
        _IDS.clear()
        _IDS[path] = Ids(path)
    return _IDS[path]


def laid_out(lists: list[np.ndarray], end: int, pad: int, begin: int):
    """Some texts in one row: input symbols, targets (-1 where a text is over), where each window begins, and each window's text.

    An input is the symbol before its target; what is before a text's begin is ``pad``.
    """
    lead = SPAN - STRIDE
    counts = np.array([-(-(len(x) + 1) // STRIDE) for x in lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts * STRIDE + lead)])
    inputs = np.full(int(starts[-1]), pad, np.int32)
    target = np.full(int(starts[-1]), -1, np.int32)
    for x, at in zip(lists, starts.tolist(), strict=False):
        at += lead
        inputs[at] = begin
        inputs[at + 1:at + 1 + len(x)] = x
        target[at:at + len(x)] = x
        target[at + len(x)] = end
    text = np.repeat(np.arange(len(lists)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return inputs, target, starts[:-1][text] + nth * STRIDE, text


def cut(inputs: np.ndarray, target: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that begin at ``first``: inputs (n x SPAN) and targets (n x STRIDE)."""
    return np.take(inputs, first[:, None] + np.arange(SPAN)), np.take(target, first[:, None] + (SPAN - STRIDE) + np.arange(STRIDE))


def windows(lists: list[np.ndarray], end: int, pad: int, begin: int):
    """All windows of some texts: inputs, targets and each window's text."""
    inputs, target, first, text = laid_out(lists, end, pad, begin)
    return *cut(inputs, target, first), text


class Vocabulary:
    """Classes of ids from their counts; the last class is the end of a text alone."""

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        order = np.lexsort((np.arange(size), -counts))
        self.of = np.zeros(size + 1, np.int64)
        single, rest = order[:SINGLE], order[SINGLE:]
        self.of[single] = np.arange(len(single))
        mass = np.cumsum(counts[rest] + 1.0)
        if len(rest):
            self.of[rest] = SINGLE + np.minimum((mass - 1) / mass[-1] * SHARED, SHARED - 1).astype(np.int64)
        self.n = SINGLE + SHARED + 1
        self.end, self.begin, self.pad = size, size + 1, size + 2
        self.of[size] = self.n - 1
        total = np.bincount(self.of[:size], counts + 1.0, minlength=self.n)
        self.within = np.concatenate([np.log10((counts + 1.0) / total[self.of[:size]]), [0.0]])
        # Inputs are the ids themselves; the begin of a text and what is before it are symbols of their own.
        self.symbol = np.arange(size + 3)


#: All weights but the embeddings, which come first.
SHAPES = (("place", (SPAN, WIDTH)), ("query", (WIDTH, WIDTH)), ("key", (WIDTH, WIDTH)), ("value", (WIDTH, WIDTH)), ("mix", (WIDTH, WIDTH)),
          ("out", (WIDTH, SINGLE + SHARED + 1)), ("bias", (SINGLE + SHARED + 1,)))
SIZES = [int(np.prod(s)) for _, s in SHAPES]


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    rest = len(flat) - sum(SIZES)
    parts = np.split(flat[rest:], np.cumsum(SIZES)[:-1])
    return {"embed": flat[:rest].reshape(-1, WIDTH)} | {name: part.reshape(shape) for (name, shape), part in zip(SHAPES, parts, strict=True)}


def start(symbols: int = SYMBOLS) -> np.ndarray:
    rng = np.random.default_rng(1)
    rest = [np.zeros(n) if name in ("bias", "mix") else rng.normal(0, 0.25, n) for (name, _), n in zip(SHAPES, SIZES, strict=True)]
    return np.concatenate([rng.normal(0, 0.25, symbols * WIDTH), *rest]).astype(np.float32)


LIMIT = np.float32(60)
CAUSAL = np.arange(SPAN)[None, :] <= (SPAN - STRIDE + np.arange(STRIDE))[:, None]

SCALE = WIDTH ** -0.5
#: What is added to the scores of the last STRIDE positions: in a window inside a text, and in one that begins it.
MASKS = np.stack([np.where(seen, np.float32(0), NEGATIVE) for seen in (CAUSAL, CAUSAL & (np.arange(SPAN) >= SPAN - STRIDE))])
GRAPHS = Graphs()


def reads(symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of some symbols below ``n``, ascending, and which of them each is."""
    flat = symbols.ravel()
    order = np.argsort(flat.astype(np.uint16) if n <= 1 << 16 else flat, kind="stable")  # 16 bits are sorted by digits
    ordered = flat[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    which = np.empty(len(flat), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


def sums_of(rows: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each of ``n`` groups."""
    cells = np.take(np.arange(n * WIDTH).reshape(n, WIDTH), which, axis=0)
    return np.bincount(cells.ravel(), rows.ravel(), minlength=n * WIDTH).reshape(n, WIDTH).astype(rows.dtype)


def gradients(p: dict[str, np.ndarray], symbols: np.ndarray, target: np.ndarray, pad: int, graphs: bool = True):
    """Mean loss in nats of the targets that are not -1, the symbols read and the gradient of their embeddings, and that of all other weights.

    Scores are products of inputs with ``query`` times ``key`` transposed, and what is attended to goes through ``value`` times
    ``mix``: no key or value of a position is computed. Products with weights run over all places of all windows at once. Weights
    of 32 bits go through ``graphs`` where onnxruntime is there.
    """
    read, which = reads(symbols, len(p["embed"]))
    x = np.take(np.take(p["embed"], read, axis=0), which, axis=0).reshape(len(symbols), SPAN, WIDTH)
    x += p["place"]
    kind = x.dtype
    last = x[:, SPAN - STRIDE:].reshape(-1, WIDTH)
    w = {"scores_of": p["query"] @ p["key"].T * kind.type(SCALE), "values_of": p["value"] @ p["mix"], "out": p["out"]}
    graphs = graphs and kind == np.float32
    ahead = GRAPHS.get("forward", lambda: forward(STRIDE, WIDTH, MASKS, None)) if graphs else None
    back = GRAPHS.get("backward", lambda: backward(STRIDE, WIDTH)) if graphs else None
    early = symbols[:, 0] == pad
    q, a, seen, h, d = (ahead or run_forward)(x=x, last=last, early=early.astype(np.int64), bias=p["bias"], **w)
    classes = target.ravel()
    real = classes >= 0
    n = max(1, int(real.sum()))
    at = np.arange(0, d.size, d.shape[1]) + np.where(real, classes, 0)
    loss = -np.log(d.ravel()[at][real] + 1e-30).sum() / n
    d.ravel()[at] -= 1
    d *= kind.type(1 / n) if n == len(classes) else (real / n).astype(kind)[:, None]
    g_out, g_values, g_scores, dl, dx = (back or run_backward)(x=x, last=last, q=q, a=a, seen=seen, h=h, d=d, **w)
    dx[:, SPAN - STRIDE:] += dl.reshape(-1, STRIDE, WIDTH)
    g_scores = g_scores * kind.type(SCALE)
    g = {"place": dx.sum(axis=0), "query": g_scores @ p["key"], "key": g_scores.T @ p["query"], "value": g_values @ p["mix"].T,
         "mix": p["value"].T @ g_values, "out": g_out, "bias": np.ones(len(d), kind) @ d}
    return float(loss), read, sums_of(dx, which, len(read)), np.concatenate([g[name].ravel() for name, _ in SHAPES])


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def run_forward(x, last, early, scores_of, values_of, out, bias):
    """``attention_graph.forward`` in numpy."""
    q = (last @ scores_of).reshape(-1, STRIDE, WIDTH)
    a = softmax(q @ x.transpose(0, 2, 1) + np.take(MASKS, early, axis=0).astype(x.dtype))
    seen = (a @ x).reshape(-1, WIDTH)
    h = seen @ values_of + last
    return q, a, seen, h, softmax(h @ out + bias)


def run_backward(x, last, q, a, seen, h, d, scores_of, values_of, out):
    """``attention_graph.backward`` in numpy."""
    dh = d @ out.T
    flat_seen = dh @ values_of.T
    d_seen = flat_seen.reshape(-1, STRIDE, WIDTH)
    # The sum of attention times its gradient, over all positions, is that of what is attended to times its own.
    ds = (d_seen @ x.transpose(0, 2, 1) - (flat_seen * seen).sum(axis=1).reshape(-1, STRIDE, 1)) * a
    dq = (ds @ x).reshape(-1, WIDTH)
    dx = a.transpose(0, 2, 1) @ d_seen + ds.transpose(0, 2, 1) @ q
    return h.T @ d, seen.T @ dh, last.T @ dq, dh + dq @ scores_of.T, dx


def gradient(flat: np.ndarray, symbols: np.ndarray, target: np.ndarray, pad: int) -> tuple[float, np.ndarray]:
    """Mean loss in nats of the targets that are not -1, and its gradient by all weights."""
    loss, read, embed, rest = gradients(unpacked(flat), symbols, target, pad)
    g = np.zeros(len(flat), np.float32)
    unpacked(g)["embed"][read] = embed
    g[len(flat) - len(rest):] = rest
    return loss, g


def whole_rows(x: np.ndarray) -> np.ndarray:
    """A table as one item a row, which is written many times faster than numbers by row."""
    return x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).reshape(-1)


class Adam:
    """Weights and their moments; embeddings and their moments move when they are read."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.m, self.s, self.step = np.zeros_like(flat), np.zeros_like(flat), 0
        self.weights, self.m_of, self.s_of = (unpacked(x)["embed"] for x in (self.flat, self.m, self.s))
        self.parts = unpacked(self.flat)
        self.rest = slice(len(flat) - sum(SIZES), None)
        self.read = np.zeros(len(self.weights), np.int64)

    def learn(self, symbols: np.ndarray, target: np.ndarray, pad: int) -> None:
        """One step over some windows."""
        _, read, embed, rest = gradients(self.parts, symbols, target, pad)
        self.step += 1
        self.read[read] += 1
        scale_m, scale_s = np.float32(RATE / (1 - 0.9 ** self.step)), np.float32(1 / (1 - 0.98 ** self.step))

        def move(x, m, s, g):
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            s *= np.float32(0.98)
            s += np.float32(0.02) * (g * g)
            x -= scale_m * m / (np.sqrt(s * scale_s) + np.float32(1e-6))

        tables = (self.weights, self.m_of, self.s_of)
        rows = [np.take(x, read, axis=0) for x in tables]
        move(*rows, embed)
        for x, own in zip(tables, rows, strict=True):
            np.put(whole_rows(x), read, whole_rows(own))
        move(*(x[self.rest] for x in (self.flat, self.m, self.s)), rest)


def trained(flat: np.ndarray, symbols: np.ndarray, target: np.ndarray, pad: int) -> np.ndarray:
    """One epoch of Adam over the given windows, in the given order."""
    adam = Adam(flat)
    for at in range(0, len(symbols), BATCH):
        adam.learn(symbols[at:at + BATCH], target[at:at + BATCH], pad)
    return adam.flat


def pieces(lists: list[np.ndarray]):
    """Consecutive lists of about PIECE_IDS ids together, so that what a step reads does not grow with an Arrow batch."""
    at, ids = 0, 0
    for i, x in enumerate(lists):
        if i > at and ids + len(x) > PIECE_IDS:
            yield lists[at:i]
            at, ids = i, 0
        ids += len(x) + 1
    if at < len(lists):
        yield lists[at:]


def epoch_of(batches, begin: np.ndarray, v: Vocabulary, epoch: int) -> tuple[Adam, int]:
    """One epoch of Adam over all windows of all texts in batches of lists of ids, and the number of windows."""
    adam, n = Adam(begin), 0
    class_of = np.append(v.of, -1).astype(np.int32)  # the target -1 takes the last entry
    for lists in (some for batch in batches for some in pieces(batch)):
        inputs, target, first, _ = laid_out(lists, v.end, v.pad, v.begin)
        classes = class_of[target]
        first = np.random.default_rng(epoch).permutation(first)
        for at in range(0, len(first), BATCH):
            adam.learn(*cut(inputs, classes, first[at:at + BATCH]), v.pad)
        n += len(first)
    return adam, n


class Scorer:
    """The model with its inner products prepared."""

    def __init__(self, flat: np.ndarray, vocabulary: Vocabulary, graphs: bool = True):
        p, self.vocabulary = unpacked(flat.astype(np.float32)), vocabulary
        self.embed, self.place = p["embed"], p["place"]
        self.weights = {"scores_of": p["query"] @ p["key"].T * np.float32(SCALE), "values_of": p["value"] @ p["mix"], "out": p["out"], "bias": p["bias"]}
        self.run = (GRAPHS.get("scores", lambda: forward(STRIDE, WIDTH, MASKS, LIMIT)) if graphs else None) or run_scores

    def scores(self, lists: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each list of ids and its end."""
        v, total = self.vocabulary, np.zeros(len(lists))
        inputs, target, first, text = laid_out(lists, v.end, v.end + 2, v.end + 1)
        for at in range(0, len(text), WINDOWS_SCORED):
            symbols, ids = cut(inputs, target, first[at:at + WINDOWS_SCORED])
            x = np.take(self.embed, symbols, axis=0)
            x += self.place
            (log,) = self.run(x=x, last=x[:, SPAN - STRIDE:].reshape(-1, WIDTH), early=(symbols[:, 0] == v.pad).astype(np.int64), **self.weights)
            real = np.flatnonzero(ids.ravel() >= 0)
            ids = ids.ravel()[real]
            log10 = np.take(log, real * v.n + v.of[ids]) / np.log(10.0) + v.within[ids]
            total += np.bincount(text[at + real // STRIDE], log10, minlength=len(lists))
        return total


def run_scores(x, last, early, scores_of, values_of, out, bias):
    """``attention_graph.forward`` with limited scores, in numpy."""
    score = (last @ scores_of).reshape(-1, STRIDE, WIDTH) @ x.transpose(0, 2, 1)
    a = softmax(np.clip(score, -LIMIT, LIMIT, out=score) + np.take(MASKS, early, axis=0))
    logits = ((a @ x).reshape(-1, WIDTH) @ values_of + last) @ out + bias
    # Scores are limited, so the exponentials need no shift by their maximum.
    np.clip(logits, -LIMIT, LIMIT, out=logits)
    return (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)),)


WORD, ID, TEXT = 0, 1, 2
GATHERED = "kind int, item long, n long, ids array<int>"


def gathered(batches, path: str):
    """Batches of (row, text) to counts of words and of ids, and all ids of each text."""
    own = ids_of(path)
    for batch in batches:
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        words, times, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(own.size, np.int64)
        for begin, texts in encoded(own, batch.column(1)):
            words.append(texts.words)
            times.append(texts.counts())
            for at, to in slices(texts.offsets, SLICE_BYTES):
                lists = texts.lists(at, to)
                flat = np.concatenate(lists)
                count += np.bincount(flat, minlength=own.size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(to - at, TEXT, np.int32)), pa.array(rows[begin + at:begin + to]), pa.array(np.ones(to - at, np.int64)),
                     c.list_column(flat.astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in lists])]))], names=["kind", "item", "n", "ids"])
        word, which = np.unique(np.concatenate(words), return_inverse=True)
        yield gathered_rows(WORD, word, np.bincount(which, np.concatenate(times), len(word)))
        seen = np.flatnonzero(count)
        yield gathered_rows(ID, seen, count[seen])


def encoded(own: Ids, column: pa.Array):
    """The texts of a column, some at a time, with the place of the first of them."""
    data, offsets = c.text_buffer(column)
    for at, to in slices(offsets, TOGETHER_BYTES):
        yield at, Encoded(own, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])


def hashed(column: pa.Array):
    """The hashes of the words of a column's texts, and each text's first word, for some texts at a time and the place of the first of them."""
    data, offsets = c.text_buffer(column)
    for at, to in slices(offsets, TOGETHER_BYTES):
        some = data[offsets[at]:offsets[to]]
        begin, end, first = c.word_spans(some, offsets[at:to + 1] - offsets[at], c.SPACE_BYTES)
        yield at, c.signed(c.word_hashes(some, begin, end, lower=True)), first


def slices(offsets: np.ndarray, most: int):
    """Texts from, to: ``most`` bytes or one text at a time."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def gathered_rows(kind: int, item: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(item), kind, np.int32)), pa.array(item.astype(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(len(item), pa.list_(pa.int32()))],
        names=["kind", "item", "n", "ids"])


AVERAGED = "part int, weights binary, n binary"


def shards(adam: Adam, n: int):
    """The embeddings in SHARDS pieces, each with the steps that read it, and the other weights with the number of windows."""
    pieces = list(zip(np.array_split(adam.weights, SHARDS), np.array_split(adam.read, SHARDS), strict=True))
    pieces.append((adam.flat[adam.rest][None], np.array([n], np.int64)))
    for part, (weights, times) in enumerate(pieces):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([weights.tobytes()], pa.binary()), pa.array([times.tobytes()], pa.binary())], names=["part", "weights", "n"])


def averaged(batches):
    """The weighted mean of each piece that a partition holds; what no partition has read stays as it began, the same in all of them."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, raw, times in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            n = np.frombuffer(times, np.int64)
            weights = np.frombuffer(raw, np.float32).reshape(len(n), -1).astype(np.float64)
            if part not in total:
                total[part] = [weights * n[:, None], n.copy(), weights]
            else:
                total[part][0] += weights * n[:, None]
                total[part][1] += n
    for part, (weights, n, begin) in total.items():
        mean = np.where(n[:, None] > 0, weights / np.maximum(n, 1)[:, None], begin).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mean.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["part", "weights", "n"])


def fit(stored: DataFrame, v: Vocabulary, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` rounds: every partition trains on all windows of its texts, then weights are averaged."""
    spark, flat = stored.sparkSession, start(len(v.symbol))
    rows = stored.where(F.col("kind") == TEXT).select("ids")
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((flat, v))

        def run(batches, shared=shared, epoch=epoch):
            begin, v = shared.value
            adam, n = epoch_of((lists_of(batch.column(0)) for batch in batches), begin, v, epoch)
            if n:
                yield from shards(adam, n)

        # The weights reach the driver once, in SHARDS + 1 pieces.
        found = rows.mapInArrow(run, AVERAGED).repartition(SHARDS + 1, "part").mapInArrow(averaged, AVERAGED).collect()
        shared.unpersist()
        if not found:
            break
        flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(found, key=lambda r: r["part"])])
    return flat


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """The ids of each text of an Arrow list column."""
    offsets, ids = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
    return [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def scored(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, n_tokens (words and the end), n_known, train_tokens, base_score and score.

    base_score sums log10((c + 1) / (N + V + 1)) over words and end, with counts over all rows that are not held out; score is the
    model's log10 probability. Null and empty texts are an end alone; texts of any length are scored whole, repeated rows
    alike; a null doc_id is the empty text for the folds. Without training rows all counts are 0 and the model is as it starts.
    Each text is encoded once, and its ids are read for the epochs and the score. The input must be a stored table, as its rows are
    numbered several times.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id"), 7, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    is_text = F.col("kind") == TEXT

    def kept(some):
        return some.select("row", "text").mapInArrow(partial(gathered, path=tokenizer), GATHERED)

    stored = c.written(kept(rows.where("NOT held_out")), "gathered")
    apart = c.written(kept(rows.where("held_out")).where(is_text), "apart")
    words = c.written(stored.where(F.col("kind") == WORD).groupBy(F.col("item").alias("word")).agg(F.sum("n").alias("n")), "words")
    n_docs = stored.where(is_text).count()
    n_words, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, distinct = n_words + n_docs, n_distinct + (n_docs > 0)

    ids = stored.where(F.col("kind") == ID).groupBy("item").agg(F.sum("n").alias("n")).collect()  # an id of the vocabulary each
    counts = np.zeros(ids_of(tokenizer).size, np.float64)
    for r in ids:
        counts[r["item"]] = r["n"]
    vocabulary = Vocabulary(counts)
    flat = fit(stored, vocabulary)

    many = F.col("n") >= max(1.0, FREQUENT_SHARE * n_words)
    frequent = words.where(many).toArrow()  # 1 / FREQUENT_SHARE rows at most
    word, n = frequent.column("word").to_numpy(), frequent.column("n").to_numpy()
    order = np.argsort(word)
    shared = spark.sparkContext.broadcast((flat, vocabulary, word[order], np.log10(n[order] + 1.0), np.log10(n_docs + 1.0), n_docs > 0))

    def frequent_words(hashes):
        """The frequent words' places in the table (-1 for others)."""
        table = shared.value[2]
        if not len(table):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return np.where(table[at] == hashes, at, -1)

    def known_words(batches):
        _, _, _, log10, end_log10, end_known = shared.value
        for batch in batches:
            known, part, n_tokens = ([np.zeros(0)] for _ in range(3))
            for _, hashes, first in hashed(batch.column(3)):
                at, n = frequent_words(hashes), len(first) - 1
                text = np.repeat(np.arange(n), np.diff(first))
                found = at >= 0
                known.append(np.bincount(text[found], minlength=n) + end_known)
                part.append(np.bincount(text[found], log10[at[found]], minlength=n) + end_log10)
                n_tokens.append(np.diff(first) + 1)
            known, part, n_tokens = (np.concatenate(x) for x in (known, part, n_tokens))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n_tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(part)],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "part"])

    def score(batches):
        model = Scorer(*shared.value[:2])
        for batch in batches:
            scores = [np.zeros(0), *(model.scores(some) for some in pieces(lists_of(batch.column(1))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], names=["row", "score"])

    def rare(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for at, hashes, first in hashed(batch.column(1)):
                row = np.repeat(rows[at:at + len(first) - 1], np.diff(first))
                other = frequent_words(hashes) < 0
                yield pa.RecordBatch.from_arrays([pa.array(row[other]), pa.array(hashes[other])], names=["row", "word"])

    docs = rows.mapInArrow(known_words, "row long, doc_id long, held_out boolean, n_tokens long, known long, part double")
    scores = stored.where(is_text).unionByName(apart).select("item", "ids").mapInArrow(score, "row long, score double")
    others = (rows.select("row", "text").mapInArrow(rare, "row long, word long").join(words.where(~many), "word")
              .groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("more_known")))
    out = docs.join(scores, "row").join(others, "row", "left")
    scale = float(np.log10(train_tokens + distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score")
