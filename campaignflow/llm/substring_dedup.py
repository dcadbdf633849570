"""Substring dedup by level-wise doubling.

A window of 35 words can repeat only if its first and its last 18 words do. So windows of 18 words are counted first; those
that occur once are dropped, and each pair of surviving windows that begin 17 words apart names one window of 35 words,
which is counted in turn. For other lengths there are more levels, each twice as long as the one before, until the wanted
length is reached or no candidate is left.

Neighbouring documents form a batch of bounded size. A batch sends each different name once, packed into one binary per
bucket of names, and gets back the places of those that another batch has, too; what repeats within a batch it knows by
itself. So a window found in a third of all documents costs its bucket one entry per batch.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignflow.llm import common as c

LENGTH = 35
#: The first level starts at 16 to 31 words, below which most windows of natural text repeat by chance.
SHORTEST = 16
#: Names of the first level only prune: a chance match of 48 bits does not survive the next level, whose names have 64 bits.
FIRST_BYTES, NEXT_BYTES = 6, 8
#: Words of a batch of documents, and as many more per bucket that it sends to, so that its parcels don't get small.
BATCH_WORDS, WORDS_PER_BUCKET, MOST_BATCH_WORDS = 1 << 18, 512, 1 << 24
BUCKETS_PER_PARTITION = 4

DIRECTORY, KNOWN, ASKED = 0, 1, 2
SCHEMA = "kind int, batch long, bucket int, n int, names binary, places binary"


def levels(length: int) -> list[int]:
    """Window lengths from the first level to ``length``; each is at most twice the one before."""
    out = [length]
    while out[0] >= 2 * SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def pack_places(at: np.ndarray) -> bytes:
    """Ascending numbers as bytes: every step is as many bytes 255 as fit, then what is left."""
    step = np.diff(at, prepend=0)
    n = step // 255 + 1
    out = np.full(int(n.sum()), 255, np.uint8)
    out[np.cumsum(n) - 1] = step % 255
    return out.tobytes()


def unpack_places(raw: bytes) -> np.ndarray:
    byte = np.frombuffer(raw, np.uint8)
    return np.cumsum(byte, dtype=np.int64)[byte != 255]


def pack_names(names: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_names(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def table(rows: list[tuple]) -> pa.RecordBatch:
    kind, batch, bucket, n, names, places = zip(*rows, strict=True) if rows else ([],) * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(batch, pa.int64()), pa.array(bucket, pa.int32()), pa.array(n, pa.int32()),
         pa.array(names, pa.binary()), pa.array(places, pa.binary())], names=["kind", "batch", "bucket", "n", "names", "places"])


def parcels(batch: int, at: np.ndarray, names: np.ndarray, width: int, buckets: int, last: bool) -> list[tuple]:
    """What a batch sends: its own repeats, and each different name once to its bucket. ``at`` ascends.

    After the last level nobody needs the names of windows that are known to repeat.
    """
    rows = []
    if not len(at):
        return rows
    order = np.argsort(names, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = names[order[1:]] != names[order[:-1]]
    run = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = np.zeros(len(order), bool)
    again[order] = np.repeat(run > 1, run)
    if again.any():
        rows.append((KNOWN, batch, batch % buckets, int(again.sum()), b"" if last else pack_names(names[again], width), pack_places(at[again])))
    once = np.sort(order[new])
    at, names = at[once], names[once]
    bucket = (names % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        part = order[ends[b]:ends[b + 1]]
        rows.append((ASKED, batch, int(b), len(part), pack_names(names[part], width), pack_places(at[part])))
    return rows


def first_level(batches, length: int, width: int, buckets: int, batch_words: int, last: bool):
    """Batches of (row, text) to parcels with the names of all windows of ``length`` words."""
    for arrow in batches:
        ids = arrow.column(0).to_numpy(zero_copy_only=False)
        data, offsets = c.text_buffer(arrow.column(1))
        begin, end, first = c.word_spans(data, offsets, c.SPACE_BYTES)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(first, first[at] + batch_words, "right")) - 1)
            to = min(to, len(ids))
            low, high = first[at], first[to]
            hashes = c.word_hashes(data, begin[low:high], end[low:high])
            starts = first[at:to + 1] - low
            batch = int(ids[at])
            place = np.flatnonzero(c.in_one_text(starts, len(hashes), length))
            names = c.gram_hashes(hashes, length)[place] >> np.uint64(64 - 8 * width)
            rows = [(DIRECTORY, batch, batch % buckets, to - at, ids[at:to].astype("<i8").tobytes(), starts.astype("<i8").tobytes())]
            yield table(rows + parcels(batch, place, names, width, buckets, last))
            at = to


def answers(group: pa.Table, width: int, last: bool) -> pa.Table:
    """One bucket's parcels to the places whose name is in two parcels or more; what is no question passes through."""
    rows = group.to_pylist()
    out = [tuple(r.values()) for r in rows if r["kind"] != ASKED]
    asked = [r for r in rows if r["kind"] == ASKED]
    if asked:
        names = np.concatenate([unpack_names(r["names"], width) for r in asked])
        order = np.argsort(names, kind="stable")
        same = np.zeros(len(names) + 1, bool)
        same[1:-1] = names[order[1:]] == names[order[:-1]]
        found = np.zeros(len(names), bool)
        found[order] = same[:-1] | same[1:]
        at = 0
        for r in asked:
            hit, mine = found[at:at + r["n"]], names[at:at + r["n"]]
            at += r["n"]
            if hit.any():
                named = b"" if last else pack_names(mine[hit], width)
                out.append((KNOWN, r["batch"], r["bucket"], int(hit.sum()), named, pack_places(unpack_places(r["places"])[hit])))
    return pa.Table.from_batches([table(out)])


def surviving(rows: list[dict], width: int) -> tuple[int, dict, np.ndarray, np.ndarray]:
    """A batch's directory row and the places and names of its windows that repeat, ascending."""
    directory = next(r for r in rows if r["kind"] == DIRECTORY)
    known = [r for r in rows if r["kind"] == KNOWN]
    if not known:
        return directory["batch"], directory, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, index = np.unique(np.concatenate([unpack_places(r["places"]) for r in known]), return_index=True)
    names = np.concatenate([unpack_names(r["names"], width) for r in known])
    return directory["batch"], directory, at, names[index] if len(names) else names


def next_level(group: pa.Table, shift: int, width: int, next_width: int, buckets: int, last: bool) -> pa.Table:
    """One batch: windows of which the part that begins ``shift`` words later survived, too, under the pair's name."""
    batch, directory, at, names = surviving(group.to_pylist(), width)
    later = np.searchsorted(at, at + shift)
    both = (later < len(at)) & (at[np.minimum(later, len(at) - 1)] == at + shift) if len(at) else np.zeros(0, bool)
    pair = c.mixed(c.mixed(names[both]) * np.uint64(c.GRAM_STEP) + names[later[both]])
    return pa.Table.from_batches([table([tuple(directory.values()), *parcels(batch, at[both], pair, next_width, buckets, last)])])


SPANS = "row long, begins array<int>, ends array<int>"


def spans(group: pa.Table, length: int, width: int) -> pa.Table:
    """One batch: merged word ranges that repeated windows cover, for each document that has any."""
    _, directory, at, _ = surviving(group.to_pylist(), width)
    ids = np.frombuffer(directory["names"], "<i8")
    first = np.frombuffer(directory["places"], "<i8")
    text = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] > at[:-1] + length)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1) if len(at) else np.zeros(0, np.int64)
    begins, ends, text = at[new] - first[text[new]], at[last] + length - first[text[last]], text[new]
    own, cut = np.unique(text, return_index=True)
    cut = np.append(cut, len(text))
    return pa.table({"row": pa.array(ids[own]), "begins": c.list_column(begins.astype(np.int32), cut), "ends": c.list_column(ends.astype(np.int32), cut)})


def repeated(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, begins, ends): the ranges of words that windows of ``length`` words with a twin elsewhere cover; ``row`` numbers the input's rows."""
    spark = documents.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    batch_words = min(MOST_BATCH_WORDS, max(BATCH_WORDS, WORDS_PER_BUCKET * buckets))
    sizes = levels(length)
    width = FIRST_BYTES if len(sizes) > 1 else NEXT_BYTES
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    sent = rows.mapInArrow(partial(first_level, length=sizes[0], width=width, buckets=buckets, batch_words=batch_words, last=len(sizes) == 1), SCHEMA)
    for size, longer in zip(sizes, [*sizes[1:], None], strict=True):
        known = sent.groupBy("bucket").applyInArrow(c.per_group(answers, width=width, last=longer is None), SCHEMA).groupBy("batch")
        if longer is None:
            return known.applyInArrow(c.per_group(spans, length=size, width=width), SPANS)
        sent = known.applyInArrow(c.per_group(next_level, shift=longer - size, width=width, next_width=NEXT_BYTES, buckets=buckets, last=longer == length), SCHEMA)
        width = NEXT_BYTES


def kept_texts(batches, names):
    """Rows of (doc_id, packed text, begins, ends) to the words that stay, joined by one space, with their digest."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, begins, ends in zip(c.unpacked_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = text.split()
            stay, at = [], 0
            for begin, end in zip(begins or (), ends or (), strict=True):
                stay += words[at:begin]
                at = end
            stay += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(stay))
            kept.append(b" ".join(stay))
        columns = {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                   "kept_text": pa.array([k.decode() for k in kept], pa.string()) if "kept_text" in names else None,
                   "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if "kept_sha256" in names else None}
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def without_repeats(documents: DataFrame, length: int = LENGTH, columns=("doc_id", "n_words", "n_removed", "kept_text")) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_removed and kept_text or kept_sha256, whichever ``columns`` names.

    Every copy of a repeated passage goes, the first included. Windows are judged on the input. Null and empty texts have no
    words; texts of any length are taken whole; rows that repeat a doc_id are documents of their own, so their common
    windows repeat. Other columns are ignored; an empty table gives no rows. The input must be a stored table, as its rows
    are numbered twice.
    """
    found = repeated(documents, length)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept_text": "string", "kept_sha256": "string"}
    joined = c.packed_texts(rows).join(found, "row", "left").select("doc_id", "packed", "begins", "ends")
    return joined.mapInArrow(partial(kept_texts, names=list(columns)), ", ".join(f"{n} {kinds[n]}" for n in columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN r USING (gram)),
n AS (SELECT doc_id, count(*) AS n_removed FROM p GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = x.doc_id AND p.p = x.i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
