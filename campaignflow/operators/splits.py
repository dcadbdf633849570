"""Train / calibration / holdout split, walk-forward folds and campaign folds."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignflow.functions.scalars import col


def _day(c="origin_date"):
    return F.unix_date(c)


def origin_cutoffs(frame: DataFrame, fractions) -> DataFrame:
    """Linear-interpolated quantiles of the origin date as one row; weighted over the distinct dates."""
    per_day = frame.groupBy(_day().alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(*[F.percentile("d", F.lit(f), F.col("n")).alias(f"cut_{i}") for i, f in enumerate(fractions)])


def chronological_split(frame: DataFrame, train: float = 0.70, calibration: float = 0.85) -> DataFrame:
    """Label rows train, calibration or holdout; rows whose target straddles a cut stay unlabelled (NULL)."""
    cuts = origin_cutoffs(frame, (train, calibration))
    resolved = _day() + F.col("horizon_days")
    label = (
        F.when(resolved <= F.col("cut_0"), "train")
        .when((_day() > F.col("cut_0")) & (resolved <= F.col("cut_1")), "calibration")
        .when(_day() > F.col("cut_1"), "holdout")
    )
    # The broadcast side is a single row.
    return frame.join(F.broadcast(cuts)).withColumn("split", label).drop("cut_0", "cut_1")


def walk_forward_roles(frame: DataFrame, n_folds: int = 4, first: float = 0.5, last: float = 0.92,
                       min_train: int = 200, min_validation: int = 50) -> DataFrame:
    """One row per usable fold and frame row that takes part in it.

    Training rows have their whole target window resolved by the cutoff; validation rows start after it.
    """
    # At most ``n_folds`` rows on the broadcast side.
    return (
        frame.join(F.broadcast(usable_folds(frame, n_folds, first, last, min_train, min_validation)))
        .withColumn("role", fold_role("cutoff"))
        .where(F.col("role").isNotNull())
    )


def fold_role(cutoff, day=None, horizon="horizon_days"):
    """train, validation or NULL for a row of origin ``day`` and ``horizon``."""
    day, cutoff = (_day() if day is None else day), col(cutoff)
    return F.when(day + F.col(horizon) <= cutoff, "train").when(day > cutoff, "validation")


def usable_folds(frame: DataFrame, n_folds: int = 4, first: float = 0.5, last: float = 0.92,
                 min_train: int = 200, min_validation: int = 50) -> DataFrame:
    """``fold`` and ``cutoff`` of the walk-forward folds that are large enough, from counts per origin day."""
    step = (last - first) / max(n_folds - 1, 1)
    spans = frame.agg(F.min(_day()).alias("lo"), F.max(_day()).alias("hi"))
    fold_array = F.array(*[
        F.struct(F.lit(i).alias("fold"),
                 F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * (first + i * step), 6).alias("cutoff"))
        for i in range(n_folds)
    ])
    folds = spans.select(F.explode(fold_array).alias("f")).select("f.*")

    per_day = frame.groupBy(_day().alias("d"), "horizon_days").agg(F.count(F.lit(1)).alias("n"))
    sizes = (
        per_day.join(F.broadcast(folds))
        .withColumn("role", fold_role("cutoff", F.col("d")))
        .groupBy("fold", "cutoff")
        .agg(F.sum(F.when(F.col("role") == "train", F.col("n"))).alias("n_train"),
             F.sum(F.when(F.col("role") == "validation", F.col("n"))).alias("n_validation"))
        .where((F.col("n_train") >= min_train) & (F.col("n_validation") >= min_validation))
    )
    return sizes.select("fold", "cutoff")


def campaign_folds(frame: DataFrame, n_folds: int = 5) -> DataFrame:
    """Assign whole campaigns to folds of similar size: ranked by size, then dealt to and fro.

    Ranks come from counts per size and hash slice, of which there are no more than days times slices, so neither the
    campaigns nor a size that most of them share stand in one task.
    """
    sizes = frame.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_rows"))
    sliced = sizes.withColumn("slice", F.substring(F.md5(F.col("campaign_id").cast("string")), 1, 2))
    classes = sliced.groupBy("n_rows", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy(F.col("n_rows").desc(), "slice")) - F.col("n")
    offsets = classes.select(F.col("n_rows").alias("of_size"), F.col("slice").alias("of_slice"), before.alias("before"))
    inside = F.row_number().over(W.partitionBy("n_rows", "slice").orderBy("campaign_id")) - 1
    ranked = sliced.withColumn("inside", inside).join(
        offsets, (F.col("n_rows") == F.col("of_size")) & F.col("slice").eqNullSafe(F.col("of_slice")))
    place = (F.col("before") + F.col("inside")) % (2 * n_folds)
    return ranked.select("campaign_id", "n_rows", F.least(place, 2 * n_folds - 1 - place).cast("int").alias("fold"))


def even_origin_subset(frame: DataFrame, k: int) -> DataFrame:
    """Rows of ``k`` origin dates spread evenly over each horizon's distinct dates."""
    dates = frame.select("horizon_days", "origin_date").distinct()
    by_horizon = W.partitionBy("horizon_days")
    ranked = dates.select(
        "horizon_days", "origin_date",
        (F.row_number().over(by_horizon.orderBy("origin_date")) - 1).alias("i"),
        F.count(F.lit(1)).over(by_horizon).alias("n"))
    step = (F.col("n") - 1) / F.lit(float(max(k - 1, 1)))
    picks = F.array(*[F.bround(step * j).cast("long") for j in range(k)])
    kept = ranked.where((F.col("n") <= k) | F.array_contains(picks, F.col("i").cast("long")))
    return frame.join(kept.select("horizon_days", "origin_date"), ["horizon_days", "origin_date"], "left_semi")
