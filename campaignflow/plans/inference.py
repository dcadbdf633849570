"""Score the latest snapshot and budget scenarios with a trained forest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignflow.functions.isotonic import isotonic
from campaignflow.functions.scalars import safe_ratio
from campaignflow.operators import bounds as B
from campaignflow.operators import calibration as C
from campaignflow.operators import curves as H
from campaignflow.operators import features as X
from campaignflow.operators import models as D
from campaignflow.plans import training as T
from campaignflow.schema import QUANTILE_COLUMNS

SHOWN = ["campaign_id", "campaign_name", "channel", "campaign_type", "origin_date", "forecast_as_of", "horizon_days",
         "planned_future_daily_budget"]


def score(trained, scenarios: DataFrame) -> DataFrame:
    """``scenarios`` with calibratable quantiles and, where the bundle has point models, ``point_forecast`` of the winner.

    Every step works inside the row: no shuffle, no join.
    """
    prepared = trained["encoder"].transform(D.prepare(scenarios))
    out = D.predict_quantiles(trained["forest"], trained["leaves"], prepared)
    shown = [*scenarios.columns, *QUANTILE_COLUMNS]
    if "point" in trained:
        out = T.predict_points(trained["point"]["models"], trained["point"]["basis"].transform(out)).withColumn("point_forecast", F.col(trained["point"]["winner"]))
        shown.append("point_forecast")
    return out.select(*shown)


def predictions(trained, canonical: DataFrame, group_days: DataFrame) -> DataFrame:
    """One calibrated, plausibility-checked forecast row per campaign and horizon."""
    live = X.expand_horizons(X.latest_snapshot(X.daily_features(canonical), canonical))
    out = C.apply_cqr(score(trained, live), trained["cqr"])
    out = out.select(*SHOWN, *QUANTILE_COLUMNS, *(["point_forecast"] if "point" in trained else []))
    out = out.withColumn("assumed_spend_total", F.col("planned_future_daily_budget") * F.col("horizon_days"))
    out = out.withColumn("roas_p50", safe_ratio("q50", "assumed_spend_total"))
    out = B.clamp_to_bounds(out, B.roas_bounds(group_days), "q50", "assumed_spend_total")
    curves = H.fit_hill_curves(group_days).drop("n_points", "note", "residual_std", "r_squared", "n_at_bound")
    return out.join(curves, H.GROUP, "left").withColumn(
        "saturation_status", H.saturation_status("planned_future_daily_budget")).drop("fit_ok", "L", "K", "n", "fallback_roas")


def whatif_sweep(trained, canonical: DataFrame, group_days: DataFrame, multipliers, horizon: int = 30) -> DataFrame:
    """Revenue quantiles per channel and for the total over a grid of budget multipliers, non-decreasing in budget.

    Every campaign is rescored at every multiplier in one job; the median is clamped to the group's ROAS envelope
    before it is summed, and each quantile's curve is made monotone over the grid.
    """
    snap = X.latest_snapshot(X.daily_features(canonical), canonical).withColumn("horizon_days", F.lit(horizon))
    grid = snap.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))).withColumn(
        "planned_future_daily_budget", X.recent_pace() * F.col("multiplier"))
    scored = score({k: v for k, v in trained.items() if k != "point"}, grid).withColumn("spend", F.col("planned_future_daily_budget") * horizon)
    clamped = B.clamp_to_bounds(scored, B.roas_bounds(group_days), "q50", "spend")
    shown = {c: (f"{c}_display" if c == "q50" else c) for c in QUANTILE_COLUMNS}
    totals = clamped.groupingSets([["multiplier"], ["multiplier", "channel"]], "multiplier", "channel").agg(
        F.sum("spend").alias("spend"), F.count_if("plausibility_flag").alias("n_flagged"),
        *[F.sum(shown[c]).alias(c) for c in QUANTILE_COLUMNS]).withColumn("scope", F.coalesce("channel", F.lit("total")))
    packed = totals.groupBy("scope").agg(F.array_sort(F.collect_list(
        F.struct("multiplier", "spend", "n_flagged", *QUANTILE_COLUMNS))).alias("p"))
    fitted = packed.select("scope", "p", *[isotonic(F.col(f"p.{c}")).alias(f"fit_{c}") for c in QUANTILE_COLUMNS])
    rows = fitted.select("scope", F.posexplode("p").alias("i", "r"), *[f"fit_{c}" for c in QUANTILE_COLUMNS])
    ordered = F.array_sort(F.array(*[F.col(f"fit_{c}")[F.col("i")] for c in QUANTILE_COLUMNS]))
    return rows.select("scope", "r.multiplier", "r.spend", "r.n_flagged", ordered.alias("q")).select(
        "scope", "multiplier", "spend", "n_flagged", *[F.col("q")[i].alias(c) for i, c in enumerate(QUANTILE_COLUMNS)])
