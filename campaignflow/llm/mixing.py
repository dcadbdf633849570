"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Every document gets an exponential key, divided by its quality weight; ascending keys are a weighted sample without
replacement. A source's budget is first spent on complete epochs, the rest on documents in key order. The cut in that
order is found by two levels of histograms and an exact look at the one fine bucket that the budget ends in, so no source
is ever sorted or held by one task, however much of the table it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignflow.llm import common as c

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = 7
BUCKETS = 1024
#: Rows of the table of sources up to which it is broadcast.
BROADCAST_SOURCES = 100_000
NOISE = "[0-9#*$%&|<>]+"


def size_of(text: Column) -> Column:
    return F.size(c.words_of(text)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for a text without digits and symbols, down to 0.05 for one that has little else."""
    text = F.coalesce(text, F.lit(""))
    noise = F.length(text) - F.length(F.regexp_replace(text, NOISE, ""))
    return F.greatest(F.lit(0.05), 1 - 2.0 * noise / F.greatest(F.length(text), F.lit(1)))


def keyed(documents: DataFrame, seed: int) -> DataFrame:
    """Adds size, weight and the sampling key of each row; the key depends on doc_id, seed and weight alone."""
    text = F.col("text").cast("string")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))
    uniform = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return documents.withColumns({"size": size_of(text), "weight": quality_weight(text)}).withColumn("key", -F.log(uniform) / F.col("weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source, source_size, target, epochs, rest. ``sizes`` has (source, source_size), one row per source.

    Sources weigh 1, 2, 3, repeating in code point order, null last. A target of ``MOST_EPOCHS`` times the source's size is
    not exceeded; the others share the rest by weight, which settles at one common level of words per weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("long"))
    df = df.withColumn("most", MOST_EPOCHS * F.col("source_size")).withColumn("limit", F.col("most") / F.col("w"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("limit", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    df = df.withColumn("level", level)
    # The first source, by its limit, that can take the common level sets it.
    df = df.withColumn("level", F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "level"))).over(everything)["level"])
    df = df.withColumn("target", F.when(F.col("limit") < F.col("level"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("w")))
    df = df.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    return df.select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def beside_sources(df: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    right = sources.withColumnRenamed("source", "of_source")
    return df.join(F.broadcast(right) if few else right, df["source"].eqNullSafe(right["of_source"])).drop("of_source")


def fine(key: Column) -> Column:
    """Bucket of a key, ascending: ``BUCKETS`` coarse ones of ``BUCKETS`` fine ones each."""
    return F.floor(key / (1 + key) * (BUCKETS * BUCKETS)).cast("long")


def cuts(df: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Per source the fine bucket that its rest ends in, and the last (key, doc_id) taken there."""

    def ending(sums: DataFrame, bucket: str) -> DataFrame:
        """The bucket of each source that its rest ends in, with what is before it."""
        up_to = Window.partitionBy("source").orderBy(bucket)
        sums = sums.withColumn("upto", F.sum("words").over(up_to) + F.col("base"))
        sums = sums.withColumn("before", F.col("upto") - F.col("words"))
        return sums.where("before <= rest AND rest < upto").select("source", "rest", bucket, F.col("before").alias("base"))

    small = df.select("source", "doc_id", "size", "key", "fine", "coarse")
    coarse = small.groupBy("source", "coarse").agg(F.sum("size").alias("words"))
    first = ending(beside_sources(coarse, sources.select("source", "rest"), few).withColumn("base", F.lit(0).cast("long")), "coarse")
    first = first.withColumnRenamed("coarse", "at_coarse")
    inner = beside_sources(small, first, few).where("coarse = at_coarse").groupBy("source", "fine", "rest", "base").agg(F.sum("size").alias("words"))
    second = c.written(ending(inner, "fine").withColumnRenamed("fine", "at_fine"), "cut")
    # Rows that repeat a doc_id share a key: they are taken or left together.
    last = beside_sources(small, second, few).where("fine = at_fine").groupBy("source", "key", "doc_id", "rest", "base", "at_fine").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("key", "doc_id")) + F.col("base")
    taken = last.withColumn("upto", upto).where("upto - words / 2 <= rest")
    marks = taken.groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("mark"))
    return beside_sources(second.select("source", "at_fine"), sources.select("source"), few).join(
        marks.withColumnRenamed("source", "m"), F.col("source").eqNullSafe(F.col("m")), "left").drop("m")


def decided(df: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``df`` (source, size, key, fine, doc_id and more) with source_size, target, copies and taken."""
    df = beside_sources(df, plan, few)
    in_cut = (F.col("fine") == F.col("at_fine")) & F.coalesce(F.struct("key", "doc_id") <= F.col("mark"), F.lit(False))
    chosen = F.coalesce((F.col("fine") < F.col("at_fine")) | in_cut, F.lit(False))
    df = df.withColumn("copies", F.col("epochs") + chosen.cast("long"))
    return df.withColumn("taken", F.col("size") * F.col("copies"))


def planned(documents: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """Keys and sizes of all rows without their texts, the plan per source, and whether the plan is small."""
    thin = keyed(documents.select("doc_id", F.col("source").cast("string").alias("source"), "text"), seed).drop("text", "weight")
    thin = c.written(thin.withColumn("fine", fine(F.col("key"))).withColumn("coarse", F.floor(F.col("fine") / BUCKETS).cast("long")), "keys")
    sources = c.written(targets(thin.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    few = sources.count() <= BROADCAST_SOURCES
    ends = cuts(thin, sources, few).withColumnRenamed("source", "e")
    plan = sources.join(ends, F.col("source").eqNullSafe(F.col("e")), "left").drop("e")
    return thin, c.written(plan, "plan"), few


def mixture(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies (times the row is taken), taken (words, repeats counted).

    The document in which the rest ends is taken if that comes nearer to the target. Null texts have size 0; null is a
    source of its own, a null doc_id an ordinary one; rows with one doc_id in one source are taken alike. Texts of any
    length count whole. Empty tables give no rows; other columns are ignored.
    """
    thin, plan, few = planned(documents, seed)
    return decided(thin, plan, few).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``documents``, all columns, each as often as ``mixture`` takes it."""
    _, plan, few = planned(documents, seed)
    whole = F.struct(*[F.col(f"`{x}`") for x in documents.columns]).alias("row")
    df = keyed(documents.select(whole, "doc_id", F.col("source").cast("string").alias("source"), "text"), seed).drop("text")
    df = decided(df.withColumn("fine", fine(F.col("key"))), plan, few)
    return df.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


#: The same rule with a plain running sum per source.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  greatest(0.05, 1 - 2.0::DOUBLE * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '{NOISE}', '', 'g'))) / greatest(length(coalesce(text, '')), 1)) AS weight,
  (('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), '{SEED}')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE AS u FROM documents),
k AS MATERIALIZED (SELECT *, -ln(u) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM k GROUP BY source),
l AS (SELECT *, {MOST_EPOCHS} * source_size AS most, {MOST_EPOCHS} * source_size / w AS lim FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lev FROM l
  WINDOW b AS (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN lim < level THEN most::DOUBLE ELSE level * w END AS target
  FROM v, (SELECT arg_min(lev, lim) AS level FROM v WHERE lev <= lim)),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs FROM t),
o AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
  sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from ``mixture``."""
    return df.select("doc_id", "size", "source_size", "target", "taken")
