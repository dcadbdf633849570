"""Words, hashes and shared helpers of the text operators.

Word scanning works on the Arrow buffer of a whole batch at once: no Python object is made for a word. Two words count
as equal when their 64-bit hashes are; with a billion different words the chance that any two collide is about 3 %.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignflow.sources.workdir import scratch

#: Separators of the words ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes that end a word, by the two word definitions in use.
SPACE_BYTES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
PUNCT_BYTES = np.array([i <= 0x2F or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F for i in LOWER])

_RANDOM = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUE = _RANDOM.integers(1, 2**64, 256, np.uint64) | np.uint64(1)
STEP, GRAM_STEP, MIX_A, MIX_B = (int(x) | 1 for x in _RANDOM.integers(2**62, 2**64, 4, np.uint64))
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and every executor can read it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Gives back the folder of a ``written`` table whose last reader is done."""
    spark = df.sparkSession
    for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(MIX_A)
    h ^= h >> np.uint64(29)
    h *= np.uint64(MIX_B)
    h ^= h >> np.uint64(32)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, one after another, and where each text begins and ends; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """Begin and end byte of every word, and for each text the index of its first word (one more entry at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(begin, offsets)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, computed slice by slice so that scratch memory stays small whatever the text's length."""
    out = np.empty(len(begin), np.uint64)
    if not len(begin):
        return out
    length = end - begin
    power = powers(STEP, int(length.max()))
    value = BYTE_VALUE[LOWER] if lower else BYTE_VALUE
    total = np.concatenate([[0], np.cumsum(length)])
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1)
        n, first = length[at:to], total[at:to] - total[at]
        within = np.arange(total[to] - total[at]) - np.repeat(first, n)
        byte = data[within + np.repeat(begin[at:to], n)]
        out[at:to] = np.add.reduceat(value[byte] * power[within], first)
        at = to
    return mixed(out + length.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each position; the last ``n - 1`` positions are left out. Built by doubling."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    step = (GRAM_STEP + 2 * seed) % 2**64
    # sums[i]: value of the next `have` words; two neighbouring stretches make one of twice the length.
    out, done, sums, have, left = np.zeros(size, np.uint64), 0, words, 1, n
    while left:
        if left & 1:
            out += sums[done:done + size] * np.uint64(pow(step, done, 2**64))
            done += have
        left >>= 1
        if left:
            sums = sums[:len(sums) - have] + sums[have:] * np.uint64(pow(step, have, 2**64))
            have *= 2
    return mixed(out + np.uint64(n))


def in_one_text(first_word: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """For each position at which ``n`` words of the batch begin: do they lie in one text?"""
    size = max(0, n_words - n + 1)
    if not size:
        return np.zeros(0, bool)
    text = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    return text[:size] == text[n - 1:n - 1 + size]


def list_column(values: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """An Arrow list column over a flat array."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def packed_texts(df: DataFrame) -> DataFrame:
    """``df`` with its column ``text`` compressed to ``packed``, for texts that are about to be shuffled; null stays null."""
    others = [n for n in df.columns if n != "text"]
    types = dict(df.dtypes)

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = batch.column(len(others)).to_pylist()
            packed = pa.array([None if t is None else press.compress(t.encode()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(others)], packed], names=[*others, "packed"])

    return df.select(*others, "text").mapInArrow(pack, ", ".join([*(f"{n} {types[n]}" for n in others), "packed binary"]))


def unpacked_texts(packed: pa.Array) -> list[bytes]:
    """The UTF-8 texts of a column ``packed``; null is empty."""
    press = zstandard.ZstdDecompressor()
    return [b"" if p is None else press.decompress(p) for p in packed.to_pylist()]


def per_group(fn, **fixed):
    """``fn(table, **fixed)`` in the form that ``applyInArrow`` recognises."""

    def run(group: pa.Table) -> pa.Table:
        return fn(group, **fixed)

    return run
