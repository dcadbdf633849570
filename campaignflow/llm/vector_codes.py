"""Compression of vectors to four bytes by product codes, trained with ball k-means in whole numbers.

Each vector becomes integers and is cut into four parts; each part position has a codebook of up to 256 entries. The parts
that an entry holds form a ball: only entries within twice its radius are neighbours that could take a part over. A part
nearer to its entry than half the way to the nearest neighbour lies in the stable core and needs no work; the others lie in
rings between successive half distances, and a part of the k-th ring is compared with the first k neighbours only. All
comparisons are of whole numbers, so the result equals that of comparing with every entry. Codes stand beside their vectors
in a table in the shared folder, one table a round, the one before deleted when its successor stands; the driver sees
codebooks and sums per entry, never vectors other than the first 256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignflow.llm.common import list_column
from campaignflow.sources.workdir import scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers are clipped to this size, so that a sum of squared differences fits a long (components beyond 65,536).
LARGEST = 1 << 26
SLICE_ROWS = 1 << 16
RINGS = 8
ROW = "vec_id long, label int, whole array<int>, codes array<int>, error long"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, whole (floor of 1024 times each component) of the rows whose vector has finite components only."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False)) & (F.size(x) > 0) & (F.size(x) % PARTS == 0))
    def one(v: Column) -> Column:
        return F.floor(F.least(F.greatest(v.cast("double") * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform(x, one).alias("whole"))


def number_type(largest: int, width: int) -> type:
    """The cheapest type in which sums of ``width`` squared differences of such integers are exact."""
    bound = 4 * width * largest * largest
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


class Balls:
    """One codebook: entries, their squared distances and, for each entry, the others from the nearest to the farthest."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        diff = entries[:, None, :] - entries[None, :, :]
        self.apart = np.einsum("ijk,ijk->ij", diff, diff)
        order = np.argsort(self.apart, axis=1, kind="stable")
        itself = order == np.arange(len(entries))[:, None]
        self.others = order[~itself].reshape(len(entries), -1)
        self.gaps = np.take_along_axis(self.apart, self.others, axis=1)

    def nearest(self, rows: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row, compared with all entries; ties to the lower index."""
        book = self.entries.astype(kind)
        squares = (book * book).sum(axis=1)
        code, best = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for at in range(0, len(rows), 4096):
            x = rows[at:at + 4096].astype(kind)
            far = squares - 2 * (x @ book.T)
            own = far.argmin(axis=1)
            code[at:at + 4096] = own
            best[at:at + 4096] = (far[np.arange(len(x)), own] + (x * x).sum(axis=1)).astype(np.int64)
        return code, best

    def moved(self, rows: np.ndarray, code: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """As ``nearest``, from the entry that held each row in the round before."""
        diff = rows - self.entries[code]
        best, code = np.einsum("ij,ij->i", diff, diff), code.copy()
        by_entry = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[by_entry], np.arange(len(self.entries) + 1))
        book = self.entries.astype(kind)
        squares = (book * book).sum(axis=1)
        for entry in np.flatnonzero(np.diff(starts)):
            ball = by_entry[starts[entry]:starts[entry + 1]]
            reach = 4 * best[ball]
            gaps = self.gaps[entry, :np.searchsorted(self.gaps[entry], reach.max(), "right")]  # neighbours of the ball
            if not len(gaps):
                continue
            ring = np.searchsorted(gaps, reach, "right")
            outside = np.argsort(ring, kind="stable")[np.count_nonzero(ring == 0):]  # the stable core is ring 0
            for some in np.array_split(outside, min(RINGS, max(1, len(outside)))):
                if not len(some):
                    continue
                at, near = ball[some], self.others[entry, :ring[some[-1]]]
                x = rows[at].astype(kind)
                far = (squares[near] - 2 * (x @ book[near].T) + (x * x).sum(axis=1)[:, None]).astype(np.int64)
                least = far.min(axis=1)
                index = np.where(far == least[:, None], near, ENTRIES).min(axis=1)
                better = (least < best[at]) | (least == best[at]) & (index < entry)
                best[at[better]], code[at[better]] = least[better], index[better]
        return code, best


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def gathered(batches, rows: int):
    """Batches joined to tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def assigned(table: DataFrame, books: np.ndarray, largest: int) -> DataFrame:
    """``table`` with each part's nearest entry of ``books`` (part, entry, place); from its codes, where it has some."""
    width = books.shape[2]
    # 4 codebooks of at most 256 entries: bounded by the length of a vector.
    shared = table.sparkSession.sparkContext.broadcast(books)
    kind = number_type(largest, width)
    again = "codes" in table.columns

    def run(batches):
        balls = [Balls(b.astype(np.int64)) for b in shared.value]
        for rows in gathered(batches, SLICE_ROWS):
            whole = matrix(rows.column("whole").chunk(0), PARTS * width).astype(np.int64)
            before = matrix(rows.column("codes").chunk(0), PARTS).astype(np.int64) if again else None
            codes, error = np.empty((len(whole), PARTS), np.int32), np.zeros(len(whole), np.int64)
            for p, ball in enumerate(balls):
                part = np.ascontiguousarray(whole[:, p * width:(p + 1) * width])
                codes[:, p], far = ball.moved(part, before[:, p], kind) if again else ball.nearest(part, kind)
                error += far
            out = pa.table({"vec_id": rows.column("vec_id"), "label": rows.column("label"), "whole": rows.column("whole"),
                            "codes": list_column(codes.ravel(), np.arange(0, codes.size + 1, PARTS)), "error": error})
            yield from out.to_batches()

    return table.mapInArrow(run, ROW)


def entry_sums(table: DataFrame, width: int, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry holds (part, entry) and the sums of their components (part, entry, place)."""

    def run(batches):
        n, sums = np.zeros((PARTS, n_entries), np.int64), np.zeros((PARTS, n_entries, width), np.int64)
        for rows in gathered(batches, SLICE_ROWS):
            whole, codes = matrix(rows.column("whole").chunk(0), PARTS * width), matrix(rows.column("codes").chunk(0), PARTS)
            for p in range(PARTS):
                n[p] += np.bincount(codes[:, p], minlength=n_entries)
                for i in range(width):
                    # Exact: at most 2**26 times 2**17 rows.
                    sums[p, :, i] += np.bincount(codes[:, p], whole[:, p * width + i], n_entries).astype(np.int64)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
             list_column(sums[part, entry].ravel(), np.arange(0, len(part) * width + 1, width), pa.int64())], names=["part", "entry", "n", "total"])

    partial = table.select("whole", "codes").mapInArrow(run, "part int, entry int, n long, total array<long>")
    # One row per entry: bounded by 4 x 256 and the length of a vector.
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width))).collect()
    n, sums = np.zeros((PARTS, n_entries), np.int64), np.zeros((PARTS, n_entries, width), np.int64)
    for r in found:
        n[r["part"], r["entry"]] = r["n"]
        sums[r["part"], r["entry"]] = r[3:]
    return n, sums


class Store:
    """The table of the current round in the shared folder; the one before is deleted once the new one is complete."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def put(self, table: DataFrame) -> DataFrame:
        path, schema = scratch(self.spark, "vectors"), table.schema
        table.write.parquet(path)
        if self.path is not None:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.path = path
        return self.spark.read.schema(schema).parquet(path)


def trained(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The coded rows (vec_id, label, whole, codes, error) and the codebooks (part, entry, place)."""
    spark = vectors.sparkSession
    store = Store(spark)
    table = store.put(whole_numbers(vectors))
    order = [F.col("vec_id").asc_nulls_last(), "whole"]
    first = table.orderBy(*order).first()
    if first is None:
        return spark.createDataFrame([], ROW), np.zeros((PARTS, 0, 0), np.int64)
    length = len(first["whole"])
    table = table.where(F.size("whole") == length)
    width = length // PARTS
    start = np.array([r["whole"] for r in table.orderBy(*order).limit(ENTRIES).select("whole").collect()], np.int64)
    books = np.ascontiguousarray(start.reshape(-1, PARTS, width).swapaxes(0, 1))
    largest = table.agg(F.max(F.greatest(F.array_max("whole"), -F.array_min("whole")))).first()[0]
    for _ in range(ROUNDS):
        table = store.put(assigned(table, books, largest))
        n, sums = entry_sums(table, width, books.shape[1])
        books = np.where(n[:, :, None] > 0, sums // np.maximum(n, 1)[:, :, None], books)
    return store.put(assigned(table, books, largest)), books


def coded(vectors: DataFrame) -> DataFrame:
    """Per kept row of ``vectors``: vec_id, code, error, label_error, codebooks_sha256.

    Kept are rows whose ``embedding`` has a number of finite components divisible by four, the same number as the kept row
    with the smallest vec_id; other rows, with nulls in the vector or none, are left out. Null vec_ids come last in the
    choice of the first entries, rows of equal vec_id stand in the order of their integers; every row is coded, repeated
    ones alike. With fewer than 256 kept rows the codebooks have as many entries. Null labels count as one label. Integers
    are clipped to 2**26 in size. Other columns are ignored; an empty table gives no rows.
    """
    table, books = trained(vectors)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = table.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    code = F.concat(*(F.lpad(F.lower(F.hex(F.col("codes")[p])), 2, "0") for p in range(PARTS)))
    rows = table.select("vec_id", code.alias("code"), "error", "label")
    # Labels may be many; which side is small enough to send around is for adaptive execution to measure.
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    rounds = []
    for i in range(ROUNDS + 1):
        # A pick is 256 times the distance plus the entry: the least is the nearest, ties to the lower index.
        rounds.append(f"""
picks{i} AS MATERIALIZED (
  SELECT r, x.p, min((xx - 2 * list_dot_product(x.v, b.v) + bb)::BIGINT * 256 + b.e) AS pick, any_value(x.v) AS v
  FROM parts x JOIN book{i} b ON x.p = b.p GROUP BY r, x.p)""")
        if i < ROUNDS:
            rounds.append(f"""
book{i + 1} AS MATERIALIZED (
  SELECT *, list_dot_product(v, v) AS bb FROM (
    SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM book{i} b LEFT JOIN (
      SELECT p, e, list(x ORDER BY j) AS v FROM (
        SELECT p, e, j, floor(sum(x) / count(*)) AS x FROM (
          SELECT p, pick & 255 AS e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM picks{i}) GROUP BY p, e, j) GROUP BY p, e) n
    ON n.p = b.p AND n.e = b.e))""")
    return """
WITH kept AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, whole) AS r FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS whole FROM embeddings
    WHERE len(embedding) > 0 AND len(embedding) % 4 = 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))),
parts AS MATERIALIZED (
  SELECT *, list_dot_product(v, v) AS xx FROM (
    SELECT r, p, whole[p * (len(whole) // 4) + 1:(p + 1) * (len(whole) // 4)] AS v FROM kept, (SELECT unnest(range(4)) AS p))),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v, xx AS bb FROM parts WHERE r <= 256),""" + ",".join(rounds) + f""",
coded AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(pick & 255)), 2, '0'), '' ORDER BY p) AS code, sum(pick >> 8)::BIGINT AS error
  FROM picks{ROUNDS} JOIN kept USING (r) GROUP BY r, vec_id, label),
digest AS (
  SELECT sha256(string_agg(x::BIGINT, ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM book{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""


ORACLE = _oracle()
