"""Interval calibration, candidate comparison, out-of-fold selection and linear attributions."""

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignflow.functions.metrics import coverage, pinball
from campaignflow.functions.quantiles import exact_quantiles, sort_row
from campaignflow.functions.scalars import safe_ratio
from campaignflow.schema import BANDS, QUANTILE_COLUMNS, quantile_column


def nonconformity(low, high, y="target_revenue"):
    return F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high))


def fit_cqr(spark, calibration: DataFrame, bands=BANDS) -> DataFrame:
    """Correction per band: the finite-sample quantile of the conformity scores, exact at any row count."""
    scores = calibration.select(*[
        nonconformity(quantile_column(lo), quantile_column(hi)).alias(f"score_{i}") for i, (lo, hi, _, _) in enumerate(bands)])

    def level(n, alpha):
        return min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)

    found = exact_quantiles(scores, {
        f"score_{i}": (f"score_{i}", partial(level, alpha=alpha)) for i, (_, _, alpha, _) in enumerate(bands)})
    rows = [(label, lo, hi, *found[f"score_{i}"]) for i, (lo, hi, _, label) in enumerate(bands)]
    return spark.createDataFrame(rows, "band string, lo double, hi double, n bigint, level double, q_hat double")


def apply_cqr(forecast: DataFrame, fit: DataFrame, bands=BANDS) -> DataFrame:
    """Widen each band by its correction, floor at 0 and re-sort the row."""
    wide = fit.agg(*[F.max(F.when(F.col("band") == label, F.col("q_hat"))).alias(f"fix_{i}") for i, (_, _, _, label) in enumerate(bands)])
    moved = {c: F.col(c) for c in QUANTILE_COLUMNS}
    for i, (lo, hi, _, _) in enumerate(bands):
        moved[quantile_column(lo)] = F.greatest(F.col(quantile_column(lo)) - F.col(f"fix_{i}"), F.lit(0.0))
        moved[quantile_column(hi)] = F.col(quantile_column(hi)) + F.col(f"fix_{i}")
    # One row on the broadcast side.
    joined = forecast.join(F.broadcast(wide))
    return joined.withColumns(dict(zip(QUANTILE_COLUMNS, sort_row(list(moved.values()))))).drop(
        *[f"fix_{i}" for i in range(len(bands))])


def reliability_table(rows: DataFrame, by, y: str = "target_revenue", bands=BANDS) -> DataFrame:
    """Nominal against empirical coverage, one row per group and band."""
    wide = rows.groupBy(*by).agg(*[
        coverage(y, quantile_column(lo), quantile_column(hi)).alias(f"c{i}") for i, (lo, hi, _, _) in enumerate(bands)])
    cells = F.array(*[
        F.struct(F.lit(label).alias("band"), F.lit(round(hi - lo, 2)).alias("nominal"), F.col(f"c{i}").alias("empirical"))
        for i, (lo, hi, _, label) in enumerate(bands)])
    return wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def compare_candidates(rows: DataFrame, candidates: dict[str, str], baseline: str, by=(), y: str = "target_revenue") -> DataFrame:
    """Median pinball loss of every candidate and of their equal-weight blend; the smallest loss wins."""
    blend = sum(F.col(c) for c in candidates.values()) / len(candidates)
    scored = {**{n: F.col(c) for n, c in candidates.items()}, "blend": blend}
    losses = rows.groupBy(*by).agg(*[pinball(y, c, 0.5).alias(n) for n, c in scored.items()])
    best = F.array_min(F.array(*[F.struct(F.col(n).alias("loss"), F.lit(n).alias("name")) for n in scored]))
    return losses.withColumns({
        "winner": best["name"], "best_loss": best["loss"],
        "improvement": safe_ratio(F.col(baseline) - best["loss"], baseline)})


def first_fold(validation: DataFrame, keys=("campaign_id", "origin_date", "horizon_days")) -> DataFrame:
    """Keep each row's prediction from the earliest fold that validated it."""
    order = W.partitionBy(*keys).orderBy("fold")
    return validation.withColumn("pick", F.row_number().over(order)).where("pick = 1").drop("pick")


def linear_attributions(rows: DataFrame, terms: dict[str, list[tuple]] | DataFrame, by, *rest, top: int = 10, min_rows: int = 20, within=()) -> DataFrame:
    """Mean absolute and signed contribution of every feature, for the total and per group, strongest first.

    A feature's contribution to a row is the sum of ``b * (x - mean x)`` over its ``terms``, pairs of (b, x) with b a number or
    column; means are those of the rows, of each combination of ``within`` where given. Contributions are aggregated
    as columns and only then turned into rows, so the input is never multiplied by the number of features. Missing values add nothing.
    ``terms`` may be one row of coefficients, ``b_<feature>`` each; then the features come before ``by``.
    """
    if isinstance(terms, DataFrame):
        features, (by, *rest) = by, rest
        rows, terms = rows.join(F.broadcast(terms)), {f: [(F.col(f"b_{f}"), f)] for f in features}
    top, min_rows = [*rest, *(top, min_rows)[len(rest):]]
    within = list(within)
    columns = {f: [(b if isinstance(b, Column) else F.lit(float(b)), x) for b, x in pairs] for f, pairs in terms.items()}
    names = list(dict.fromkeys(x for pairs in columns.values() for _, x in pairs))
    means = rows.groupBy(*within).agg(*[F.avg(x).alias(f"m_{x}") for x in names])
    # One row, or one per combination of ``within``, which adaptive execution measures.
    joined = rows.join(means, within) if within else rows.join(F.broadcast(means))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for f, pairs in columns.items():
        c = sum(F.coalesce(b * (F.col(x) - F.col(f"m_{x}")), F.lit(0.0)) for b, x in pairs)
        aggs += [F.sum(F.abs(c)).alias(f"a_{f}"), F.sum(c).alias(f"s_{f}")]
    # The total comes from the groups' sums, one row each, not from the rows again.
    groups = joined.groupBy(*within, by).agg(*aggs)
    sums = [F.sum(c).alias(c) for c in ("n_rows", *(f"{k}_{f}" for f in terms for k in ("a", "s")))]
    keys = [F.col(w) for w in within]
    grouped = groups.groupingSets([keys, [*keys, F.col(by)]], *within, by).agg(*sums).withColumn(by, F.coalesce(by, F.lit("total")))
    grouped = grouped.select(*within, by, "n_rows", *[(F.col(f"{k}_{f}") / F.col("n_rows")).alias(f"{k}_{f}") for f in terms for k in ("a", "s")])
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"a_{f}").alias("mean_abs"), F.col(f"s_{f}").alias("mean_signed"))
        for f in terms])
    ranked = W.partitionBy(*within, by).orderBy(F.col("mean_abs").desc(), "feature")
    return (
        grouped.where(F.col("n_rows") >= min_rows)
        .select(*within, by, "n_rows", F.explode(cells).alias("c")).select(*within, by, "n_rows", "c.*")
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    )
