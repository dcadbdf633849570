"""Benchmark decontamination by winnowing.

Texts become word hashes. Of every ``GRAM + WINDOW - 1 = 13`` consecutive words, the smallest hash among their 6-word
grams is kept on both sides, so any 13 shared words share a kept gram at the same place. Kept grams of documents that
pass a fixed-size bit filter of the benchmark's grams are joined with them, and each match is extended word by word to both
sides; stretches of 13 words or more are hits. Items shorter than 13 words are windows of their own: all grams of that
length are kept.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignflow.llm import common as c

SPAN = 13
GRAM = 6
#: Bits of the filter that spares neighbours of grams which no item has; it only saves work.
FILTER_BITS = 1 << 23
#: Rows of benchmark grams (about 250 bytes each) up to which they are broadcast; beyond, the join shuffles with salt.
BROADCAST_ROWS = 50_000
SALT = 16


def kept_grams(hashes: np.ndarray, first_word: np.ndarray, size: int):
    """Positions and hashes of the grams that winnowing keeps for shared spans of ``size`` words; ties are all kept."""
    gram = GRAM if size == SPAN else size
    window = size - gram + 1
    grams = c.gram_hashes(hashes, gram, seed=size)
    whole = c.in_one_text(first_word, len(hashes), size)
    if not len(whole):
        return np.zeros(0, np.int64), grams[:0]
    low = np.lib.stride_tricks.sliding_window_view(grams, window).min(axis=1) if window > 1 else grams
    # A gram is kept if it equals the smallest of some window that it stands in.
    keep = np.zeros(len(grams), bool)
    for shift in range(window):
        keep[shift:shift + len(low)] |= whole & (grams[shift:shift + len(low)] == low)
    at = np.flatnonzero(keep)
    return at, grams[at]


def filter_bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def surroundings(hashes: np.ndarray, first_word: np.ndarray, at: np.ndarray, size: int, pad: int) -> np.ndarray:
    """The gram at each position with the words that a span of ``size`` words around it can have; ``pad`` is beyond the text."""
    gram = GRAM if size == SPAN else size
    reach = size - gram
    text = np.searchsorted(first_word, at, "right") - 1
    place = at[:, None] + np.arange(-reach, gram + reach)[None, :]
    outside = (place < first_word[text][:, None]) | (place >= first_word[text + 1][:, None])
    out = hashes.view(np.int64)[np.where(outside, 0, place)]
    out[outside] = pad
    return out


SCHEMA = "id long, n_words long, size int, gram long, at long, around array<long>"


def gram_rows(batches, sizes, bits=None, pad=0, whole_item=False):
    """Rows of kept grams of each batch of (id, text); a row without a gram states each text's number of words.

    ``bits``: only grams whose filter bit is set. ``whole_item``: a text shorter than ``SPAN`` is one window by itself.
    """
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = c.text_buffer(batch.column(1))
        begin, end, first = c.word_spans(data, offsets, c.PUNCT_BYTES)
        hashes = c.word_hashes(data, begin, end, lower=True)
        count = np.diff(first)
        nothing = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(count), pa.nulls(len(ids), pa.int32()), nothing, nothing, pa.nulls(len(ids), pa.list_(pa.int64()))],
            names=["id", "n_words", "size", "gram", "at", "around"])
        for size in sizes:
            at, grams = kept_grams(hashes, first, size)
            text = np.searchsorted(first, at, "right") - 1
            ok = np.ones(len(at), bool)
            if whole_item and size < SPAN:
                ok = count[text] == size
            if bits is not None:
                number = filter_bits(grams)
                ok &= (bits[number >> 3] >> (number & 7).astype(np.uint8)) & 1 == 1
            at, grams, text = at[ok], grams[ok], text[ok]
            if not len(at):
                continue
            around = surroundings(hashes, first, at, size, pad)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[text]), pa.array(count[text]), pa.array(np.full(len(at), size, np.int32)), pa.array(c.signed(grams)),
                 pa.array(at - first[text]), c.list_column(around.ravel(), np.arange(len(at) + 1) * around.shape[1])],
                names=["id", "n_words", "size", "gram", "at", "around"])


def benchmark_grams(benchmark: DataFrame) -> DataFrame:
    """(size, gram, around, item_ids) of every item: one row for equal surroundings, so repeated items join once."""
    rows = (benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(partial(gram_rows, sizes=range(1, SPAN + 1), pad=-1, whole_item=True), SCHEMA))
    return (rows.where("gram IS NOT NULL").groupBy("size", "gram", "around")
            .agg(F.sort_array(F.collect_set("id")).alias("item_ids")))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, spans (merged [begin, end) word ranges that items cover), n_hit, item_ids.

    Every input row gives one row, also rows that repeat a doc_id. Null or empty texts and items have no words, hence no hits; null
    item_ids are left out of the list but their windows count as hits; other columns are ignored. Very long texts are
    worked on whole. Rows are told apart by their place in the input, which must be a stored table.
    """
    return _found(documents.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text"), benchmark).drop("id")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, that are not contaminated."""
    row = F.monotonically_increasing_id().alias("id")
    bad = digest(_found(documents.select(row, "doc_id", "text"), benchmark), "id").where("contaminated").select("id")
    whole = F.struct(*[F.col(f"`{x}`") for x in documents.columns]).alias("whole")
    return documents.select(row, whole).join(bad, "id", "left_anti").select("whole.*")


def _found(numbered: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` of rows (id, doc_id, text), with the id."""
    spark = numbered.sparkSession
    items = c.written(benchmark_grams(benchmark), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # 13 values at most
    number = F.shiftrightunsigned("gram", 64 - FILTER_BITS.bit_length() + 1)
    bits = np.zeros(FILTER_BITS, bool)
    bits[[r[0] for r in items.select(number).distinct().collect()]] = True  # FILTER_BITS values at most
    shared = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def grams(batches):
        yield from gram_rows(batches, sizes, shared.value)

    rows = (numbered.select("id", F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
            .mapInArrow(with_doc_id(grams), SCHEMA + ", doc_id long"))
    few = items.count() <= BROADCAST_ROWS
    right = items.withColumnRenamed("around", "item_around")
    if few:
        joined = rows.join(F.broadcast(right), ["size", "gram"], "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.hash("id", "at"), F.lit(SALT)))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.join(right, ["size", "gram", "salt"], "left")
    same = F.zip_with("around", "item_around", lambda a, b: a == b)
    gram = F.when(F.col("size") == SPAN, GRAM).otherwise(F.col("size"))
    reach = F.col("size") - gram

    def run(flags):
        """Length of the run of true values that ``flags`` begins with."""
        stop = F.array_position(flags, F.lit(False)).cast("int")
        return F.when(stop > 0, stop - 1).otherwise(F.size(flags))

    joined = (joined.withColumn("same", same).withColumn("gram_size", gram).withColumn("reach", reach)
              .withColumn("left_run", run(F.reverse(F.slice("same", 1, F.col("reach")))))
              .withColumn("right_run", run(F.slice("same", F.col("reach") + 1, F.col("gram_size") + F.col("reach")))))
    hit = (F.col("right_run") >= F.col("gram_size")) & (F.col("left_run") + F.col("right_run") >= F.col("size"))
    found = joined.select(
        "doc_id", "id", "n_words",
        F.when(hit, F.struct((F.col("at") - F.col("left_run")).alias("begin"), (F.col("at") + F.col("right_run")).alias("end"))).alias("span"),
        F.when(hit, F.col("item_ids")).alias("item_ids"))
    per_doc = found.groupBy("id", "doc_id", "n_words").agg(
        F.collect_set("span").alias("spans"), F.collect_set("item_ids").alias("lists"))
    start = F.struct(F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("done"),
                     F.lit(-1).cast("long").alias("begin"), F.lit(-1).cast("long").alias("end"))

    def extend(acc, s):
        closed = F.when(acc["begin"] < 0, acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end")))))
        return F.when(s["begin"] <= acc["end"], F.struct(acc["done"].alias("done"), acc["begin"].alias("begin"),
                                                         F.greatest(acc["end"], s["end"]).alias("end"))).otherwise(
            F.struct(closed.alias("done"), s["begin"].alias("begin"), s["end"].alias("end")))

    def finish(acc):
        return F.when(acc["begin"] < 0, acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end")))))

    merged = per_doc.withColumn("spans", F.aggregate(F.sort_array("spans"), start, extend, finish))
    return merged.select(
        "id", "doc_id", "n_words", "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]).alias("n_hit"),
        F.array_distinct(F.flatten("lists")).alias("item_ids"))


def with_doc_id(rows):
    """Let ``rows`` see (id, text) and put the third column back beside what it yields."""

    def run(batches):
        for batch in batches:
            ids, doc_ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            order = np.argsort(ids, kind="stable")
            for out in rows([batch.select([0, 1])]):
                place = order[np.searchsorted(ids, out.column(0).to_numpy(zero_copy_only=False), sorter=order)]
                yield pa.RecordBatch.from_arrays([*out.columns, doc_ids.take(pa.array(place))], names=[*out.schema.names, "doc_id"])

    return run


def digest(found: DataFrame, *more: str) -> DataFrame:
    """The contract's columns from ``contamination``: contaminated if at least a twentieth of the words is hit."""
    return found.select(
        *more, "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS MATERIALIZED (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.gram = bw.gram),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
