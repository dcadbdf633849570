"""Daily features per campaign, forward targets and the latest snapshot."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignflow.functions.calendar import calendar_columns, iso_week_key
from campaignflow.functions.scalars import safe_ratio
from campaignflow.operators.daily import campaign_day, dense_calendar
from campaignflow.schema import FEATURES, FRAME_KEYS, HORIZONS, MIN_ORIGIN_AGE

def by_campaign():
    return W.partitionBy("campaign_id")


def by_date():
    return by_campaign().orderBy("date")


def last_days(days: int):
    """The current day and the ones before it, ``days`` in all."""
    return by_date().rowsBetween(1 - days, 0)


def to_date():
    return by_date().rowsBetween(W.unboundedPreceding, 0)


def add_daily_features(dense: DataFrame) -> DataFrame:
    """Append every feature known at the end of each calendar day.

    All windows share the campaign partitioning of the dense calendar, so no further shuffle is added.
    Columns a caller does not select are pruned together with their window expressions.
    """
    out = dense.select("*", F.min("date").over(by_campaign()).alias("first_date"), iso_week_key("date").alias("iso_key"))
    out = out.withColumns(calendar_columns("date"))

    windows = {
        "campaign_age_days": F.datediff("date", "first_date"),
        "last_nonzero_date": F.last(F.when(F.col("revenue") > 0, F.col("date")), ignorenulls=True).over(to_date()),
        "was_observed_frac_30": F.avg("was_observed").over(last_days(30)),
        "n_days_to_date": F.count(F.lit(1)).over(to_date()),
        "revenue_to_date": F.sum("revenue").over(to_date()),
        "spend_to_date": F.sum("spend").over(to_date()),
        # Same ISO week one year earlier, summed over the days that were actually reported.
        "revenue_same_week_last_year": F.sum(F.when(F.col("was_observed") == 1, F.col("revenue"))).over(
            by_campaign().orderBy("iso_key").rangeBetween(-100, -100)
        ),
    }
    for days in (7, 14, 28):
        windows[f"revenue_lag_{days}"] = F.lag("revenue", days).over(by_date())
        windows[f"spend_lag_{days}"] = F.lag("spend", days).over(by_date())
    for days in (7, 28):
        windows[f"conversions_lag_{days}"] = F.lag("conversions", days).over(by_date())
        windows[f"revenue_roll_mean_{days}"] = F.avg("revenue").over(last_days(days))
        windows[f"revenue_roll_std_{days}"] = F.stddev_samp("revenue").over(last_days(days))
        windows[f"spend_roll_mean_{days}"] = F.avg("spend").over(last_days(days))
    for days in (7, 14, 28, 56):
        windows[f"revenue_roll_sum_{days}"] = F.sum("revenue").over(last_days(days))
        windows[f"spend_roll_sum_{days}"] = F.sum("spend").over(last_days(days))
    for c in ("conversions", "clicks", "impressions", "reach", "video_views"):
        windows[f"{c}_roll_sum_28"] = F.sum(c).over(last_days(28))
    out = out.withColumns(windows)

    out = out.withColumns(
        {
            "days_since_last_nonzero_revenue": F.coalesce(
                F.datediff("date", "last_nonzero_date"), F.col("campaign_age_days")
            ),
            **funnel_ratios(),
            **{f"trailing_roas_{d}": safe_ratio(f"revenue_roll_sum_{d}", f"spend_roll_sum_{d}") for d in (7, 28, 56)},
            "revenue_trend_14_28": F.col("revenue_roll_mean_28") - F.lag("revenue_roll_mean_28", 14).over(by_date()),
            "campaign_expanding_revenue_mean": F.col("revenue_to_date") / F.col("n_days_to_date"),
            "campaign_expanding_roas": safe_ratio("revenue_to_date", "spend_to_date"),
        }
    )
    return out.drop("first_date", "iso_key", "last_nonzero_date", "n_days_to_date", "revenue_to_date", "spend_to_date")


def funnel_ratios():
    """Trailing 28-day funnel ratios; undefined ones are NULL."""
    return {
        "ctr_roll_28": safe_ratio("clicks_roll_sum_28", "impressions_roll_sum_28"),
        "cvr_roll_28": safe_ratio("conversions_roll_sum_28", "clicks_roll_sum_28"),
        "cpm_roll_28": safe_ratio("spend_roll_sum_28", "impressions_roll_sum_28") * 1000.0,
        "cpa_roll_28": safe_ratio("spend_roll_sum_28", "conversions_roll_sum_28"),
        "frequency_roll_28": safe_ratio("impressions_roll_sum_28", "reach_roll_sum_28"),
        "video_view_rate_roll_28": safe_ratio("video_views_roll_sum_28", "impressions_roll_sum_28"),
    }


def daily_features(canonical: DataFrame) -> DataFrame:
    """Canonical rows to one feature row per campaign and calendar day."""
    return add_daily_features(dense_calendar(campaign_day(canonical)))


def forward_targets(daily: DataFrame, horizons=HORIZONS, stride: int = 1,
                    min_age: int = MIN_ORIGIN_AGE) -> DataFrame:
    """One row per campaign, origin day and horizon whose whole forward window lies inside the calendar.

    The target is revenue over the ``h`` days after the origin; realised spend over the same days, per
    day, stands in for the planned budget.
    """
    indexed = daily.select(
        "*",
        (F.row_number().over(by_date()) - 1).alias("day_index"),
        F.count(F.lit(1)).over(by_campaign()).alias("n_days"),
        *[F.sum("revenue").over(by_date().rowsBetween(1, h)).alias(f"revenue_next_{h}") for h in horizons],
        *[F.sum("spend").over(by_date().rowsBetween(1, h)).alias(f"spend_next_{h}") for h in horizons],
    )
    origins = indexed.where(
        (F.col("day_index") >= min_age)
        & ((F.col("day_index") - min_age) % stride == 0)
        & (F.col("day_index") + min(horizons) < F.col("n_days"))
    )
    per_horizon = F.explode(
        F.array(*[
            F.struct(
                F.lit(h).alias("horizon_days"),
                F.col(f"revenue_next_{h}").alias("target_revenue"),
                F.col(f"spend_next_{h}").alias("actual_spend_sum"),
            )
            for h in horizons
        ])
    )
    return (
        origins.withColumn("t", per_horizon)
        .where(F.col("day_index") + F.col("t.horizon_days") < F.col("n_days"))
        .withColumns({
            "horizon_days": F.col("t.horizon_days"),
            "target_revenue": F.col("t.target_revenue"),
            "actual_spend_sum": F.col("t.actual_spend_sum"),
            "planned_future_daily_budget": F.col("t.actual_spend_sum") / F.col("t.horizon_days"),
        })
        .withColumnRenamed("date", "origin_date")
        .drop("t", "day_index", "n_days", *[f"{c}_next_{h}" for h in horizons for c in ("revenue", "spend")])
    )


def training_frame(canonical: DataFrame, horizons=HORIZONS, stride: int = 1) -> DataFrame:
    """Keys, targets and the full feature manifest."""
    frame = forward_targets(daily_features(canonical), horizons, stride)
    columns = list(dict.fromkeys([*FRAME_KEYS, "target_revenue", "actual_spend_sum", *FEATURES]))
    return frame.select(*columns)


def latest_snapshot(daily: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Each campaign's own last calendar day, tagged with the last day of the whole data set.

    ``observed``: the rows that ``daily`` was built from. Their dates alone give the last day, which spares building the
    calendar and its shuffle a second time.
    """
    newest = daily.withColumn("last_date", F.max("date").over(by_campaign())).where(F.col("date") == F.col("last_date"))
    as_of = (newest if observed is None else observed).agg(F.max("date").alias("forecast_as_of"))
    return newest.drop("last_date").withColumnRenamed("date", "origin_date").join(F.broadcast(as_of))


def expand_horizons(snapshot: DataFrame, horizons=HORIZONS) -> DataFrame:
    """One scoring row per campaign and horizon, planned at the campaign's recent pace."""
    return snapshot.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn(
        "planned_future_daily_budget", recent_pace()
    )


def recent_pace():
    """Trailing 28-day mean spend, else the spend a week ago, else 0."""
    return F.coalesce("spend_roll_mean_28", "spend_lag_7", F.lit(0.0))
