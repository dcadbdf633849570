"""Exact token counts from a histogram of encoded lengths.

Documents are aggregated by length; sums over all greater lengths then answer, for every context limit, how many
documents and tokens there are, fit, or are left after truncation, and which length any quantile has.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campaignflow.llm.attention_lm import ids_of

#: Lengths are summed in groups of this many first, so no window sees all lengths at once.
GROUP = 1024


def length_rows(batches, path: str):
    """Batches of texts to their distinct lengths and how many texts have them."""
    own = ids_of(path)
    for batch in batches:
        lengths = np.array(own.lengths(batch.column(0).to_pylist()), np.int64)
        length, n = np.unique(lengths, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n)], names=["length", "n_docs"])


def histogram(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(length, n_docs): documents by number of ids. Null and empty texts have length 0; every row counts, repeats too."""
    texts = documents.select(F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(partial(length_rows, path=tokenizer), "length long, n_docs long")
    return rows.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def cumulative(hist: DataFrame) -> DataFrame:
    """Per length L that occurs, as a context limit: n_docs and n_tokens of that length, docs_over and tokens_over (longer
    documents), total_docs, total_tokens, truncated_tokens (all documents cut at L), lost_tokens, and share_fitting (the quantile that L is).

    An empty histogram gives no rows.
    """
    df = hist.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "bin": F.floor(F.col("length") / GROUP)})
    bins = df.groupBy("bin").agg(F.sum("n_docs").alias("bin_docs"), F.sum("n_tokens").alias("bin_tokens"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = bins.select(
        "bin", F.coalesce(F.sum("bin_docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("bin_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("bin_docs").over(everything).alias("total_docs"), F.sum("bin_tokens").over(everything).alias("total_tokens"))
    longer = Window.partitionBy("bin").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(F.broadcast(bins), "bin")  # one row per GROUP lengths of the longest document
    df = df.withColumns({
        "docs_over": F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_above"),
        "tokens_over": F.coalesce(F.sum("n_tokens").over(longer), F.lit(0)) + F.col("tokens_above")})
    kept = F.col("total_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")
    return df.select(
        "length", "n_docs", "n_tokens", "docs_over", "tokens_over", "total_docs", "total_tokens", kept.alias("truncated_tokens"),
        (F.col("total_tokens") - kept).alias("lost_tokens"), ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("share_fitting"))


def at_limits(table: DataFrame, limits: list[int]) -> list[tuple[int, int, int]]:
    """(limit, truncated tokens, documents cut) for any limits, from ``cumulative``: the longest length up to a limit answers it."""
    below = [F.max_by(F.struct("docs_over", "tokens_over"), F.when(F.col("length") <= x, F.col("length"))) for x in limits]
    *found, docs, tokens = table.agg(*below, F.max("total_docs"), F.max("total_tokens")).first()
    out = []
    for limit, row in zip(limits, found, strict=True):
        cut, longer = (row["docs_over"], row["tokens_over"]) if row else (docs or 0, tokens or 0)
        out.append((limit, (tokens or 0) - longer + limit * cut, cut))
    return out


def quantile(table: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share ``q`` of all documents does not exceed; None without documents."""
    row = table.where(F.col("total_docs") - F.col("docs_over") >= F.lit(q) * F.col("total_docs")).agg(F.min("length").alias("x")).first()
    return row["x"]
