"""Adaptive context-mixing range coder for token ids.

A segment is cut into blocks that share nothing but the segment's table of id frequencies (order 0). Within a block,
two tables that start empty predict the next id from the last one (order 1) and the last two (order 2). Each prediction
gets, on top of the order-0 frequencies, a weight that follows how often predictions of its order and confidence have come
true so far, and the id is coded by arithmetic coding under that mixture. All blocks of a segment advance together, one id
each, as numpy arrays; a block decodes alone just as well.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 18
SLOT_BITS = 10
CONFIDENCES = 4
BLOCK_IDS, LEAST_BLOCK_IDS, WANTED_BLOCKS = 2048, 1024, 256
#: Predictions weigh at most this many times all order-0 frequencies together.
MOST_WEIGHT = 16
REFRESH = 32
MAGIC = b"TIDS2\0"
U64 = np.uint64
LOW32 = U64(0xFFFFFFFF)
BITS32 = U64(32)


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Order-0 frequencies of 0 .. max id, each 1 or more; their sum is 2 ** SCALE_BITS, or a larger power for wide alphabets."""
    size = int(ids.max()) + 1 if len(ids) else 1
    count = np.bincount(ids, minlength=size).astype(np.int64)
    bits = max(SCALE_BITS, (size * 2 - 1).bit_length())
    out = 1 + count * ((1 << bits) - size) // max(1, len(ids))
    out[int(out.argmax())] += (1 << bits) - int(out.sum())
    return out


class Model:
    """Prediction tables and weights of several blocks that advance together. Orders 1 and 2 stand in two rows of one array."""

    def __init__(self, blocks: int, freq: np.ndarray):
        self.total = int(freq.sum())
        # Half as wide where all sums fit, which halves what the steps move.
        self.wide = np.int32 if self.total * (2 * MOST_WEIGHT + 1) < 1 << 31 else np.int64
        self.freq, self.cum = freq.astype(self.wide), (np.cumsum(freq) - freq).astype(self.wide)
        self.tables = np.zeros(2 * (blocks << SLOT_BITS), np.int32)
        lane = np.arange(2 * blocks, dtype=np.int64).reshape(2, blocks)
        self.base, self.lane = lane << SLOT_BITS, lane * CONFIDENCES
        self.hits = np.ones(2 * blocks * CONFIDENCES, np.int64)
        self.tries = np.full(2 * blocks * CONFIDENCES, 4, np.int64)
        self.weigh()

    def weigh(self) -> None:
        miss = self.tries - self.hits
        self.weights = np.minimum(self.total * self.hits // np.maximum(miss, 1), MOST_WEIGHT * self.total).astype(self.wide)

    def places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places in the tables (... x 2 x blocks) after the last id ``one`` and the one before it, ``two`` (... x blocks), 32 bits wide."""
        at = np.empty((*one.shape[:-1], 2, one.shape[-1]), np.int32)
        mixed = one * np.int32(40503)  # only low bits are used, so products may wrap
        np.right_shift(mixed, 3, out=at[..., 0, :])
        np.right_shift(mixed ^ (two * np.int32(30011) + np.int32(77)), 2, out=at[..., 1, :])
        at &= (1 << SLOT_BITS) - 1
        return at + self.base[:, :one.shape[-1]]

    def learn(self, at: np.ndarray, entry: np.ndarray, x: np.ndarray, hit: np.ndarray) -> None:
        """The entries at ``at`` have met the ids ``x`` (both 32 bits wide); ``hit`` are those that had predicted them."""
        sure = entry & 3
        lower = np.where(sure, entry - 1, x << 2)
        self.tables[at] = np.where(hit, entry + (sure != 3), lower)

    def count(self, classes: np.ndarray, hit: np.ndarray, last: int) -> None:
        """Predictions of some steps up to ``last`` and which came true; weights follow every REFRESH steps."""
        n = np.bincount((classes << 1 | hit).ravel(), minlength=2 * len(self.hits)).reshape(-1, 2)
        self.hits += n[:, 1]
        self.tries += n.sum(axis=1)
        if last % REFRESH == 0:
            self.weigh()


def strides(size: int, rest: int, blocks: int):
    """Steps from, to, and how many blocks take them: REFRESH steps at most, and the last block has ``rest`` steps."""
    ends = sorted({*range(0, size, REFRESH), rest, size})
    for begin, end in zip(ends[:-1], ends[1:], strict=True):
        n = blocks if begin < rest else blocks - 1
        if n:
            yield begin, end, n


def block_size(n: int) -> int:
    return min(BLOCK_IDS, max(LEAST_BLOCK_IDS, n // WANTED_BLOCKS))


def narrowed(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Blocks whose range is below 32 bits and must give out a word; a range across a word's border is cut at it."""
    out = np.flatnonzero(span <= LOW32)
    if len(out):
        lo, sp = low[out], span[out]
        cross = (lo >> BITS32) != ((lo + (sp - U64(1))) >> BITS32)
        span[out] = np.where(cross, U64(1 << 32) - (lo & LOW32), sp)
    return out


def encode(ids: np.ndarray) -> bytes:
    """A segment of any number of ids, each below 2 ** 31."""
    ids = np.asarray(ids, np.int64)
    freq = frequencies(ids)
    table = zlib.compress(freq.astype("<u4").tobytes(), 6)
    size = block_size(len(ids))
    blocks = -(-len(ids) // size)
    words = [np.zeros(0, np.uint32)] * blocks
    if blocks:
        padded = np.zeros(blocks * size, np.int32)
        padded[:len(ids)] = ids
        # Two rows of zeros first: what is before a block.
        steps = np.concatenate([np.zeros((2, blocks), np.int32), padded.reshape(blocks, size).T])
        model = Model(blocks, freq)
        low, span = np.zeros(blocks, U64), np.full(blocks, 0xFFFFFFFFFFFFFFFF, U64)
        out_lane, out_word = [], []
        for begin, end, n in strides(size, len(ids) - (blocks - 1) * size, blocks):
            x = steps[begin + 2:end + 2, :n]
            at = model.places(steps[begin + 1:end + 1, :n], steps[begin:end, :n])
            entries, hit = np.empty(at.shape, np.int32), np.empty(at.shape, bool)
            for step, entry in enumerate(entries):
                model.tables.take(at[step], out=entry, mode="clip")
                model.learn(at[step], entry, x[step], np.equal(entry >> 2, x[step], out=hit[step]))
            # The weights stand still in a stride, so its intervals are found together.
            classes, predicted = (entries & 3) + model.lane[:, :n], entries >> 2
            weight = model.weights.take(classes)
            less = weight * (predicted < x[:, None])
            start = (model.cum[x] + less[:, 0] + less[:, 1]).astype(U64)
            more = weight * hit
            own = (model.freq[x] + more[:, 0] + more[:, 1]).astype(U64)
            whole = (weight[:, 0] + weight[:, 1] + model.total).astype(U64)
            model.count(classes, hit, end)
            for step in range(end - begin):
                unit = span[:n] // whole[step]
                low[:n] += unit * start[step]
                np.multiply(unit, own[step], out=span[:n])
                give = narrowed(low[:n], span[:n])
                if len(give):
                    lo = low[give]
                    out_lane.append(give)
                    out_word.append((lo >> BITS32).astype(np.uint32))
                    low[give] = lo << BITS32
                    span[give] <<= BITS32
        every = np.arange(blocks)
        lane = np.concatenate([*out_lane, every, every])
        word = np.concatenate([*out_word, (low >> BITS32).astype(np.uint32), (low & LOW32).astype(np.uint32)])
        order = np.argsort(lane, kind="stable")
        words = np.split(word[order], np.cumsum(np.bincount(lane, minlength=blocks))[:-1])
    head = struct.pack("<QIII", len(ids), size, blocks, len(table))
    directory = b"".join(
        struct.pack("<III", len(w), zlib.crc32(ids[i * size:(i + 1) * size].astype("<u4").tobytes()), zlib.crc32(w.astype("<u4").tobytes()))
        for i, w in enumerate(words))
    checked = head + table + directory
    return MAGIC + checked + struct.pack("<I", zlib.crc32(checked)) + b"".join(w.astype("<u4").tobytes() for w in words)


def _opened(raw: bytes):
    if raw[:len(MAGIC)] != MAGIC:
        raise ValueError("not a segment of ids")
    at = len(MAGIC)
    n, size, blocks, n_table = struct.unpack_from("<QIII", raw, at)
    end = at + 20 + n_table + 12 * blocks
    if zlib.crc32(raw[at:end]) != struct.unpack_from("<I", raw, end)[0]:
        raise ValueError("the segment's header is damaged")
    freq = np.frombuffer(zlib.decompress(raw[at + 20:at + 20 + n_table]), "<u4").astype(np.int64)
    directory = np.frombuffer(raw, "<u4", 3 * blocks, at + 20 + n_table).reshape(blocks, 3)
    return n, size, blocks, freq, directory, end + 4


def decode(raw: bytes, only: list[int] | None = None) -> np.ndarray:
    """The ids of a segment, or of the blocks ``only`` (ascending) one after another; every block's checksum is verified."""
    n, size, blocks, freq, directory, at = _opened(raw)
    begin = at + 4 * np.concatenate([[0], np.cumsum(directory[:, 0].astype(np.int64))])
    chosen = np.arange(blocks) if only is None else np.asarray(only)
    length = np.minimum(size, n - chosen * size)
    if not len(chosen):
        return np.zeros(0, np.int64)
    for b in chosen:
        if zlib.crc32(raw[begin[b]:begin[b + 1]]) != directory[b, 2]:
            raise ValueError(f"block {b} is damaged")
    data = np.concatenate([*(np.frombuffer(raw, "<u4", int(directory[b, 0]), int(begin[b])) for b in chosen), np.zeros(2, np.uint32)]).astype(U64)
    read = np.concatenate([[0], np.cumsum(directory[chosen, 0].astype(np.int64))])[:-1]
    model = Model(len(chosen), freq)
    cum, freq, total = model.cum, model.freq, model.total
    # The last order-0 unit of each id: what predictions add to it lies behind.
    last_unit = cum + freq - 1
    of = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    low, span = np.zeros(len(chosen), U64), np.full(len(chosen), 0xFFFFFFFFFFFFFFFF, U64)
    ahead = (data[read] << BITS32) | data[read + 1]
    read += 2
    most = int(length.max())
    out = np.zeros((most + 2, len(chosen)), np.int32)
    for begin, end, k in strides(most, int(length[-1]), len(chosen)):
        classes, hit = np.empty((end - begin, 2, k), np.int64), np.empty((end - begin, 2, k), bool)
        lane = model.lane[:, :k]
        for step in range(begin, end):
            at = model.places(out[step + 1, :k], out[step, :k])
            entry = model.tables.take(at)
            predicted = entry >> 2
            weight = model.weights.take(np.add(entry & 3, lane, out=classes[step - begin]))
            (p1, p2), (m1, m2) = predicted, weight
            whole = (m1 + m2 + total).astype(U64)
            unit = span[:k] // whole
            unit_at = np.minimum(ahead[:k] // unit, whole - U64(1)).astype(model.wide)
            # Without what the predictions add, first that of order 1, it is a place among the order-0 frequencies.
            extra = unit_at - last_unit[p1] - (p2 < p1) * m2
            unit_at -= np.minimum(np.maximum(extra, 0), m1)
            extra = unit_at - last_unit[p2]
            unit_at -= np.minimum(np.maximum(extra, 0), m2)
            x = of[unit_at]
            right = np.equal(predicted, x, out=hit[step - begin])
            shift = unit * (cum[x] + (p1 < x) * m1 + (p2 < x) * m2).astype(U64)
            low[:k] += shift
            ahead[:k] -= shift
            np.multiply(unit, (freq[x] + right[0] * m1 + right[1] * m2).astype(U64), out=span[:k])
            give = narrowed(low[:k], span[:k])
            if len(give):
                low[give] <<= BITS32
                span[give] <<= BITS32
                ahead[give] = (ahead[give] << BITS32) | data[read[give]]
                read[give] += 1
            out[step + 2, :k] = x
            model.learn(at, entry, x, right)
        model.count(classes, hit, end)
    out = out[2:]
    ids = np.concatenate([out[:length[i], i] for i in range(len(chosen))]).astype(np.int64)
    ends = np.cumsum(length)
    for i, b in enumerate(chosen):
        if zlib.crc32(ids[ends[i] - length[i]:ends[i]].astype("<u4").tobytes()) != directory[b, 1]:
            raise ValueError(f"block {b} does not decode to what was written")
    return ids
