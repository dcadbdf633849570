"""Token ids of documents in range-coded binary segments, written in order of doc_id and read back.

A file is a Parquet table whose rows are segments: ``part`` and ``segment`` give their order, ``ids`` holds the coded ids
(see ``range_coder``), ``documents`` the doc_id and number of ids of each document with a checksum. Any Spark reader or
store can move them, each segment stands for itself and none is larger than one document or SEGMENT_IDS ids.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campaignflow.llm import common as c
from campaignflow.llm import range_coder
from campaignflow.llm.tokens import encoder

SEGMENT_IDS = 1 << 22
END = 0
SEGMENTS = "part int, segment int, n_ids long, n_documents int, ids binary, documents binary"
NULL_ID = -(1 << 63)


def directory(doc_ids: list[int], counts: list[int]) -> bytes:
    raw = np.array(doc_ids, "<i8").tobytes() + np.array(counts, "<u4").tobytes()
    return struct.pack("<II", len(doc_ids), zlib.crc32(raw)) + raw


def opened_directory(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, check = struct.unpack_from("<II", raw)
    if zlib.crc32(raw[8:]) != check:
        raise ValueError("a segment's list of documents is damaged")
    return np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n)


def segments(batches, path: str, end: int):
    """Batches of (doc_id, text), in order, to segments."""
    own, part, number = encoder(path), TaskContext.get().partitionId(), 0
    tail = np.array([end], np.uint32).tobytes()
    doc_ids, counts, raw, n = [], [], [], 0

    def packed():
        ids = np.frombuffer(b"".join(raw), np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(doc_ids)], pa.int32()),
             pa.array([range_coder.encode(ids)], pa.binary()), pa.array([directory(doc_ids, counts)], pa.binary())],
            names=["part", "segment", "n_ids", "n_documents", "ids", "documents"])

    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
            size = len(ids) // 4 + 1
            if raw and n + size > SEGMENT_IDS:
                yield packed()
                doc_ids, counts, raw, n = [], [], [], 0
                number += 1
            doc_ids.append(NULL_ID if doc_id is None else doc_id)
            counts.append(size)
            raw += [ids, tail]
            n += size
    if raw:
        yield packed()


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Write the ids of all documents, each followed by ``end``, to ``path`` in ascending doc_id order, null first.

    Null texts are empty, so they give ``end`` alone; rows that repeat a doc_id stand side by side; texts of any length are
    encoded whole. Other columns are ignored. An empty table gives files without segments.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # the second splits what repeats one doc_id
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(partial(segments, path=tokenizer, end=end), SEGMENTS)
    rows.write.option("compression", "none").parquet(path)


DOCUMENTS = "part int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long"


def read_segments(batches, with_ids: bool):
    for batch in batches:
        for row in batch.to_pylist():
            doc_ids, counts = opened_directory(row["documents"])
            ids = range_coder.decode(row["ids"]).astype("<u4")
            ends = np.cumsum(counts.astype(np.int64))
            raw = memoryview(ids.tobytes())
            starts = ends - counts
            columns = [pa.array(np.full(len(doc_ids), row["part"], np.int32)), pa.array(np.full(len(doc_ids), row["segment"], np.int32)),
                       pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(starts), pa.array(counts.astype(np.int64)),
                       pa.array([zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())]
            names = ["part", "segment", "doc_id", "place", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(c.list_column(ids.astype(np.int64), np.append(starts, ends[-1:])))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids."""
    stored = spark.read.schema(SEGMENTS).parquet(path)
    sizes = c.written(stored.select("part", "segment", "n_ids"), "segments")
    # Sums over parts first: the window without partitions sees one row per part.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    bases = sizes.withColumn("before_segment", within).join(parts, "part").select("part", "segment", (F.col("before_part") + F.col("before_segment")).alias("base"))
    rows = stored.mapInArrow(partial(read_segments, with_ids=with_ids), DOCUMENTS + (", ids array<long>" if with_ids else ""))
    out = rows.join(bases, ["part", "segment"])
    return out.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
