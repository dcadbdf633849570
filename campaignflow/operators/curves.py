"""Spend-response curves per group: grid least squares, response, marginal return, saturation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignflow.functions.scalars import clip, col, safe_ratio

GROUP = ["channel", "campaign_type"]
N_MIN, N_MAX = 0.3, 6.0
# First grid: K from max/1024 to max*32 in octaves, n over its whole range.
K_STEPS = [float(j) for j in range(-10, 6)]
N_STEPS = [0.3, 0.5, 0.75, 1.0, 1.4, 1.9, 2.6, 3.6, 4.8, 6.0]
# Refinements around the best pair: octaves of K and shares of n, three rounds.
REFINE = [
    ([j / 4 for j in range(-3, 4)], [j / 10 for j in range(-3, 4)]),
    ([j / 16 for j in range(-3, 4)], [j / 40 for j in range(-3, 4)]),
    ([j / 64 for j in range(-3, 4)], [j / 160 for j in range(-3, 4)]),
]


def hill(x, L, K, n) -> Column:
    """``L x^n / (K^n + x^n + 1e-9)``."""
    x = F.greatest(col(x), F.lit(0.0))
    xn = F.pow(x, col(n))
    return col(L) * xn / (F.pow(col(K), col(n)) + xn + 1e-9)


def response(x, fit_ok="fit_ok", L="L", K="K", n="n", fallback="fallback_roas") -> Column:
    """Revenue at a spend level: the fitted curve, or the flat historical ROAS line."""
    return F.when(col(fit_ok), hill(x, L, K, n)).otherwise(col(x) * F.coalesce(col(fallback), F.lit(0.0)))


def marginal(x, fit_ok="fit_ok", L="L", K="K", n="n", fallback="fallback_roas") -> Column:
    """Return on the next unit of spend."""
    x = F.greatest(col(x).cast("double"), F.lit(1e-6))
    kn, xn = F.pow(col(K), col(n)), F.pow(x, col(n))
    slope = col(L) * col(n) * kn * F.pow(x, col(n) - 1) / (F.pow(kn + xn, F.lit(2.0)) + 1e-9)
    return F.when(col(fit_ok), slope).otherwise(F.coalesce(col(fallback), F.lit(0.0)))


def saturation_status(spend, fit_ok="fit_ok", K="K") -> Column:
    ratio = safe_ratio(spend, K)
    return (
        F.when(col(fit_ok).isNull(), "unknown_no_curve")
        .when(~col(fit_ok), "unknown_insufficient_data")
        .when(ratio < 0.5, "room_to_grow")
        .when(ratio < 1.5, "approaching_saturation")
        .otherwise("near_saturation")
    )


def divergence(old_spend, new_spend, model_ratio, threshold: float = 1.75) -> dict[str, Column]:
    """Compare the curve's revenue ratio for a spend change with the forecast model's own ratio."""
    checked = col("fit_ok") & (col(old_spend) > 0)
    before = response(old_spend)
    hill_ratio = F.when(checked & (before > 1e-6), response(new_spend) / before)
    apart = F.greatest(col(model_ratio), hill_ratio) / F.greatest(F.least(col(model_ratio), hill_ratio), F.lit(1e-6))
    return {
        "hill_checked": F.coalesce(checked, F.lit(False)),
        "hill_ratio": hill_ratio,
        "hill_divergence_flag": F.coalesce((hill_ratio > 1e-6) & (apart >= threshold), F.lit(False)),
    }


def weighted_points(group_days: DataFrame, keys=GROUP, half_life=45.0) -> DataFrame:
    """Positive-spend days with their recency weight; ``half_life`` NULL weighs every day alike."""
    hl = half_life if isinstance(half_life, Column) else F.lit(half_life).cast("double")
    last = F.max("date").over(W.partitionBy(*keys))
    age = F.datediff(last, "date").cast("double")
    weight = F.coalesce(clip(F.pow(F.lit(0.5), age / hl), 1e-3, 1.0), F.lit(1.0))
    return group_days.where(F.col("spend") > 0).select(
        *keys, "date", F.col("spend").alias("x"), F.col("revenue").alias("y"), weight.alias("w"))


def recency_roas(points: DataFrame, keys=GROUP) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.coalesce(safe_ratio(F.sum(F.col("y") * F.col("w")), F.sum(F.col("x") * F.col("w"))), F.lit(0.0)).alias("fallback_roas"),
        F.count(F.lit(1)).alias("n_points"))


def _best(points: DataFrame, start: DataFrame, keys, grid, first: bool = False) -> DataFrame:
    """Try a grid of (K, n) around each group's starting pair; closed-form L, smallest weighted error wins.

    Every point meets the few candidates of its own group and is summed away again before the shuffle.
    ``grid`` lists (octaves of K, n or share of n). Sums without weights give the residual spread on the way.
    """
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in grid])
    n = F.col("o.m") if first else clip(F.col("n0") * (1 + F.col("o.m")), N_MIN, N_MAX)
    K = F.col("K0") * F.pow(F.lit(2.0), F.col("o.k"))
    tried = points.join(start, list(keys)).select("*", F.explode(offsets).alias("o"))
    # x^n as exp(n ln x): the same value, cheaper than a general power.
    tried = tried.select(*keys, "K0", "n0", "L_max", "o", "y", "w", F.exp(n * F.col("ln_x")).alias("xn"),
                         F.exp(n * F.ln(K)).alias("kn"))
    tried = tried.withColumn("h", F.col("xn") / (F.col("kn") + F.col("xn") + 1e-9))
    y, w, h = F.col("y"), F.col("w"), F.col("h")
    sums = tried.groupBy(*keys, "K0", "n0", "L_max", "o").agg(
        F.sum(w * y * y).alias("a"), F.sum(w * h * y).alias("b"), F.sum(w * h * h).alias("c"),
        F.count(y).alias("cnt"), F.sum(y).alias("sy"), F.sum(h).alias("sh"), F.sum(y * y).alias("syy"),
        F.sum(y * h).alias("syh"), F.sum(h * h).alias("shh"))
    fit = sums.withColumns({"L": F.least(F.coalesce(safe_ratio("b", "c"), F.lit(0.0)), F.col("L_max")), "n": n, "K": K})
    L, cnt = F.col("L"), F.col("cnt")
    mean = (F.col("sy") - L * F.col("sh")) / cnt
    spread = (F.col("syy") - 2 * L * F.col("syh") + L * L * F.col("shh")) / cnt - mean * mean
    scored = fit.withColumns({
        "sse": F.col("a") - 2 * L * F.col("b") + L * L * F.col("c"),
        "resid": F.sqrt(F.greatest(spread, F.lit(0.0)))})
    best = scored.groupBy(*keys, "L_max").agg(F.min(F.struct("sse", "n", "K", "L", "resid")).alias("best"))
    return best.select(*keys, "L_max", F.col("best.K").alias("K0"), F.col("best.n").alias("n0"), "best")


def fit_hill_curves(group_days: DataFrame, keys=GROUP, half_life=45.0, min_points: int = 8,
                    min_levels: int = 5, min_r_squared: float = 0.10) -> DataFrame:
    """Fit every group at once by profile least squares over a (K, n) grid refined three times.

    For fixed K and n the best L is a ratio of two sums, so a pass over the points is one partially combined
    aggregation. A group has at most one point per calendar day. Poor fits (low weighted R2, or n on the edge
    of its range) fall back to the recency-weighted ROAS line.
    """
    keys = list(keys)
    # Spread the days of a group over all tasks: the grid makes them expensive and the sums combine anyway.
    tasks = int(group_days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = weighted_points(group_days, keys, half_life).repartition(tasks, *keys, "date")
    stats = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_distinct(F.bround("x", 0)).alias("n_levels"),
        F.sum("y").alias("sum_y"), F.max("y").alias("max_y"), F.max("x").alias("max_x"),
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("swy"),
        F.sum(F.col("w") * F.col("y") * F.col("y")).alias("swyy"),
        F.stddev_pop("y").alias("std_y"),
        F.coalesce(safe_ratio(F.sum(F.col("y") * F.col("w")), F.sum(F.col("x") * F.col("w"))), F.lit(0.0)).alias("fallback_roas"),
    )
    attempt = (F.col("n_points") >= min_points) & (F.col("n_levels") >= min_levels) & (F.col("sum_y") > 0)
    start = stats.where(attempt).select(
        *keys, ((F.col("max_y") * 1.5 + 1.0) * 20 + 1).alias("L_max"), F.col("max_x").alias("K0"), F.lit(1.0).alias("n0"))
    logged = points.select(*keys, F.ln("x").alias("ln_x"), "y", "w")
    best = _best(logged, start, keys, [(k, n) for k in K_STEPS for n in N_STEPS], first=True)
    for octaves, shares in REFINE:
        best = _best(logged, best.drop("best"), keys, [(k, m) for k in octaves for m in shares])
    chosen = best.select(*keys, "best.*")

    total = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    out = stats.join(chosen, keys, "left").withColumns({
        "r_squared": F.when(F.col("sse").isNotNull(), F.when(total > 0, 1 - F.col("sse") / total).otherwise(0.0)),
        "n_at_bound": (F.col("n") <= N_MIN * 1.001) | (F.col("n") >= N_MAX * 0.999),
    })
    ok = F.coalesce((F.col("r_squared") >= min_r_squared) & ~F.col("n_at_bound"), F.lit(False))
    note = (
        F.when(F.col("sse").isNull(), "insufficient_data_for_fit_attempt")
        .when(ok, "fit_ok")
        .when(F.col("n_at_bound"), "fit_rejected_n_at_bound")
        .otherwise("fit_rejected_low_r_squared")
    )
    return out.select(
        *keys, ok.alias("fit_ok"), "n_points", "fallback_roas",
        *[F.when(ok, F.col(c)).alias(c) for c in ("L", "K", "n")],
        F.round("r_squared", 4).alias("r_squared"), "n_at_bound", note.alias("note"),
        F.coalesce("resid", "std_y").alias("residual_std"))


def chart_points(curves: DataFrame, current: DataFrame, observed_max: DataFrame, steps: int = 200) -> DataFrame:
    """Evenly spaced response curve per group, from 0 to beyond the observed and current spend."""
    base = curves.join(observed_max, GROUP).join(current, GROUP, "left")
    top = F.greatest(F.col("max_spend") * 1.15, F.coalesce(F.col("K"), F.lit(0.0)) * 2.2,
                     F.coalesce(F.col("current_spend"), F.lit(0.0)) * 1.15, F.lit(1.0))
    xs = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn(
        "spend", top * F.col("i") / (steps - 1))
    return xs.select(*GROUP, "i", "spend", response("spend").alias("revenue"))
