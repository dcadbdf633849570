"""Walk-forward allocation backtest and the hindsight regret audit."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignflow.functions.scalars import safe_ratio
from campaignflow.operators.allocation import allocate
from campaignflow.operators.curves import GROUP, fit_hill_curves, response
from campaignflow.sources.workdir import checkpointed


def trailing_budget(group_days: DataFrame, days: int = 28) -> DataFrame:
    """Average daily spend since ``days`` days before the last day (both ends included)."""
    daily = group_days.groupBy("date").agg(F.sum("spend").alias("spend"))
    last = daily.agg(F.max("date").alias("last"))
    return daily.join(F.broadcast(last)).where(F.col("date") >= F.date_sub("last", days)).agg(
        (F.sum("spend") / days).alias("total_budget"))


def replan_windows(group_days: DataFrame, horizon: int = 90, every: int = 30, lookback: int = 15) -> DataFrame:
    """One row per replanning window over the last ``horizon`` days."""
    n = math.ceil(horizon / every)
    start = F.date_sub(F.max("date"), horizon)
    row = group_days.agg(start.alias("s"))
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("window"), F.date_add("s", i * every).alias("window_start"),
                 F.date_add("s", min((i + 1) * every, horizon)).alias("window_end"),
                 F.date_add("s", i * every - lookback).alias("score_from"))
        for i in range(n)])).alias("w")).select("w.*", F.datediff("w.window_end", "w.window_start").alias("n_days"))


def policy_plans(group_days: DataFrame, total_budget: DataFrame | None = None, horizon: int = 90,
                 every: int = 30, lookback: int = 15, half_life: float = 45.0, steps: int = 200) -> DataFrame:
    """Per window and group: the frozen and the re-planned daily spend, and the revenue of both on the window's own curve.

    A history row is copied once per window it serves, as decision history (before the window) or as scoring
    data (the window and its lookback); all curves are then fitted in one grouped job and all allocations in
    another. Only the few windows repeat, never the source rows: the input is one row per group and day. Groups without
    a curve in the window earn nothing there. ``fresh_fit``: the group has a fitted curve to decide by in this window.
    """
    windows = replan_windows(group_days, horizon, every, lookback)
    budget = trailing_budget(group_days) if total_budget is None else total_budget
    packed = windows.agg(F.sort_array(F.collect_list(F.struct("window", "window_start", "window_end", "score_from"))).alias("ws"))
    day = F.col("date")
    roles = F.concat(
        F.transform(F.filter("ws", lambda w: day < w["window_start"]),
                    lambda w: F.struct(w["window"].alias("window"), F.lit("decide").alias("role"))),
        F.transform(F.filter("ws", lambda w: (day >= w["score_from"]) & (day < w["window_end"])),
                    lambda w: F.struct(w["window"].alias("window"), F.lit("score").alias("role"))))
    # One row on the broadcast side.
    used = group_days.join(F.broadcast(packed)).withColumn("u", F.explode(roles)).select(
        "u.window", "u.role", *GROUP, "date", "spend", "revenue")

    keys = ["window", "role", *GROUP]
    # A few rows per window and group, read several times below: cut the long fitting plan here.
    curves = checkpointed(fit_hill_curves(used, keys, half_life=F.when(F.col("role") == "decide", F.lit(half_life))))
    decide = curves.where(F.col("role") == "decide").drop("role")
    score = curves.where(F.col("role") == "score").drop("role")

    history = used.where(F.col("role") == "decide")
    span = history.groupBy("window").agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("span"))
    spent = history.groupBy("window", *GROUP).agg(F.sum("spend").alias("spent"))
    decide = decide.join(spent, ["window", *GROUP]).join(span, "window").withColumn(
        "historical_spend", F.col("spent") / F.col("span"))
    budgets = windows.select("window").join(F.broadcast(budget))
    plans = checkpointed(allocate(decide, budgets, scenario=["window"], steps=steps))

    # The plan of the first window serves every window; a window's number is all that is added to its rows.
    every_window = F.explode(F.array(*[F.lit(i) for i in range(math.ceil(horizon / every))]))
    frozen = plans.where(F.col("window") == 0).select(*GROUP, F.col("allocation").alias("frozen"), every_window.alias("window"))
    replanned = plans.select("window", *GROUP, F.col("allocation").alias("replan"))
    fresh = decide.select("window", *GROUP, F.col("fit_ok").alias("fresh_fit"))
    both = frozen.join(replanned, ["window", *GROUP], "full").join(fresh, ["window", *GROUP], "full")
    scored = both.join(score, ["window", *GROUP], "left").withColumns({
        f"{p}_revenue": F.coalesce(F.when(F.col("fit_ok").isNotNull(), response(p)), F.lit(0.0)) for p in ("frozen", "replan")})
    return windows.drop("score_from").join(scored, "window").select(
        *windows.drop("score_from").columns, *GROUP, "frozen", "replan", "frozen_revenue", "replan_revenue", F.coalesce("fresh_fit", F.lit(False)).alias("fresh_fit"))


def policy_summary(plans: DataFrame) -> DataFrame:
    """Totals of ``policy_plans`` per window."""
    return plans.groupBy("window", "window_start", "window_end", "n_days").agg(
        *[F.coalesce(F.sum(f"{p}_revenue"), F.lit(0.0)).alias(f"{p}_daily_revenue") for p in ("frozen", "replan")],
        *[F.coalesce(F.sum(p), F.lit(0.0)).alias(f"{p}_daily_spend") for p in ("frozen", "replan")],
        F.count_if("fresh_fit").alias("n_fresh_fits"))


def policy_backtest(group_days: DataFrame, total_budget: DataFrame | None = None, **options) -> DataFrame:
    """Score a frozen plan against re-planning at every window, both on the window's own curves."""
    return policy_summary(policy_plans(group_days, total_budget, **options))


def actual_windows(group_days: DataFrame, windows: DataFrame) -> DataFrame:
    """What really happened in each window, per day."""
    packed = windows.agg(F.collect_list(F.struct("window", "window_start", "window_end", "n_days")).alias("ws"))
    day = F.col("date")
    hit = F.filter("ws", lambda w: (day >= w["window_start"]) & (day < w["window_end"]))
    return (
        group_days.join(F.broadcast(packed))
        .withColumn("w", F.explode(hit))
        .groupBy("w.window", "w.window_start", "w.window_end", "w.n_days")
        .agg((F.sum("revenue") / F.greatest(F.col("w.n_days"), F.lit(1))).alias("actual_daily_revenue"),
             (F.sum("spend") / F.greatest(F.col("w.n_days"), F.lit(1))).alias("actual_daily_spend"))
    )


def regret_audit(group_days: DataFrame, backtest: DataFrame) -> DataFrame:
    """Day-weighted averages of both policies against the actual outcome, and the regret per window."""
    actual = actual_windows(group_days, backtest).drop("window_start", "window_end", "n_days")
    joined = backtest.join(actual, "window")
    days = F.sum("n_days")

    def mean(c):
        return F.sum(F.col(c) * F.col("n_days")) / days

    out = joined.agg(
        days.alias("n_days"), mean("actual_daily_revenue").alias("actual_avg"),
        mean("frozen_daily_revenue").alias("frozen_avg"), mean("replan_daily_revenue").alias("replan_avg"))
    return out.withColumns({
        "frozen_vs_actual": safe_ratio("frozen_avg", "actual_avg") - 1,
        "replan_vs_actual": safe_ratio("replan_avg", "actual_avg") - 1,
        "replan_vs_frozen": safe_ratio("replan_avg", "frozen_avg") - 1,
    })
