"""Daily aggregation, dense calendar, feature and target queries."""

from pyspark.sql import functions as F

from campaignflow.operators import daily as D
from campaignflow.operators import features as X
from campaignflow.registry.base_sql import CTES, DENSE, FEATURES, FRAME, SNAPSHOT, with_ctes
from campaignflow.registry.core import iso, query, rnd, rounded, sql_iso, sql_rnd, sql_rounded
from campaignflow.sources.fixtures import ad_canonical

SUMS = ["spend", "revenue", "clicks", "impressions", "conversions"]


def features(spark, sf_dir):
    return X.daily_features(ad_canonical(spark, sf_dir))


@query("canonical_daily", with_ctes(
    f"SELECT campaign_id, {sql_iso('date', 'day')}, campaign_name, channel, campaign_type, "
    f"{sql_rounded(4, *SUMS)}, daily_budget FROM daily", "canonical", "daily"))
def canonical_daily(spark, sf_dir):
    d = D.campaign_day(ad_canonical(spark, sf_dir))
    return d.select("campaign_id", iso("date", "day"), "campaign_name", "channel", "campaign_type",
                    *rounded(4, *SUMS), "daily_budget")


@query("null_preserving_sum", with_ctes(
    f"SELECT campaign_id, {sql_iso('date', 'day')}, {sql_rounded(4, 'reach', 'video_views')} FROM daily",
    "canonical", "daily"))
def null_preserving_sum(spark, sf_dir):
    d = D.campaign_day(ad_canonical(spark, sf_dir))
    return d.select("campaign_id", iso("date", "day"), *rounded(4, "reach", "video_views"))


@query("dense_calendar", with_ctes(
    "SELECT campaign_id, count(*) AS n_days, CAST(sum(was_observed) AS BIGINT) AS n_observed, "
    f"{sql_iso('min(date)', 'first_day')}, {sql_iso('max(date)', 'last_day')} FROM dense GROUP BY campaign_id",
    *DENSE))
def dense_calendar(spark, sf_dir):
    d = D.dense_calendar(D.campaign_day(ad_canonical(spark, sf_dir)))
    return d.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("was_observed").alias("n_observed"),
        iso(F.min("date"), "first_day"), iso(F.max("date"), "last_day"))


@query("gap_fill", with_ctes(
    f"SELECT campaign_id, {sql_iso('date', 'day')}, was_observed, campaign_name, daily_budget, "
    f"{sql_rounded(4, 'spend', 'revenue', 'reach', 'video_views')} FROM dense", *DENSE))
def gap_fill(spark, sf_dir):
    d = D.dense_calendar(D.campaign_day(ad_canonical(spark, sf_dir)))
    return d.select("campaign_id", iso("date", "day"), "was_observed", "campaign_name", "daily_budget",
                    *rounded(4, "spend", "revenue", "reach", "video_views"))


def feature_query(name, sums=(), ratios=(), plain=()):
    """Register the named feature columns of the daily table, rounded for comparison."""
    cols = [f"campaign_id, {sql_iso('date', 'day')}"]
    if plain:
        cols.append(", ".join(plain))
    if sums:
        cols.append(sql_rounded(4, *sums))
    if ratios:
        cols.append(sql_rounded(6, *ratios))

    @query(name, with_ctes(f"SELECT {', '.join(cols)} FROM features", *FEATURES))
    def run(spark, sf_dir):
        return features(spark, sf_dir).select("campaign_id", iso("date", "day"), *plain,
                                              *rounded(4, *sums), *rounded(6, *ratios))


feature_query("lag_features", sums=[f"{c}_lag_{d}" for d in (7, 14, 28) for c in ("revenue", "spend")]
              + ["conversions_lag_7", "conversions_lag_28"])
feature_query("rolling_sums", sums=[f"{c}_roll_sum_{d}" for d in (7, 14, 28, 56) for c in ("revenue", "spend")])
feature_query("rolling_means", ratios=[f"{c}_roll_mean_{d}" for d in (7, 28) for c in ("revenue", "spend")])
feature_query("rolling_std", sums=["revenue_roll_std_7", "revenue_roll_std_28"])
feature_query("activity_sums", sums=[f"{c}_roll_sum_28" for c in
                                     ("conversions", "clicks", "impressions", "reach", "video_views")],
              ratios=["was_observed_frac_30"])
feature_query("funnel_ratios", ratios=["ctr_roll_28", "cvr_roll_28", "cpm_roll_28", "cpa_roll_28",
                                       "frequency_roll_28", "video_view_rate_roll_28"])
feature_query("trailing_roas", ratios=["trailing_roas_7", "trailing_roas_28", "trailing_roas_56"])
feature_query("trend", ratios=["revenue_trend_14_28"])
feature_query("days_since_revenue", plain=["campaign_age_days", "days_since_last_nonzero_revenue"])
feature_query("expanding_stats", ratios=["campaign_expanding_revenue_mean", "campaign_expanding_roas"])


@query("yoy_week", with_ctes(f"""
SELECT d.campaign_id, {sql_iso('d.date', 'day')},
       {sql_rnd('w.revenue', 4)} AS revenue_same_week_last_year
FROM dense d LEFT JOIN (
  SELECT campaign_id, isoyear(date) AS y, weekofyear(date) AS k, sum(revenue) AS revenue
  FROM daily GROUP BY ALL) w
ON w.campaign_id = d.campaign_id AND w.y = isoyear(d.date) - 1 AND w.k = weekofyear(d.date)""", *DENSE))
def yoy_week(spark, sf_dir):
    return features(spark, sf_dir).select("campaign_id", iso("date", "day"),
                                          rnd("revenue_same_week_last_year").alias("revenue_same_week_last_year"))


@query("calendar_flags", with_ctes(f"""
SELECT DISTINCT {sql_iso('date', 'day')}, CAST(month(date) AS INTEGER) AS month,
       CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
       CAST(last_day(date) = date AS INTEGER) AS is_month_end, CAST(month(date) >= 10 AS INTEGER) AS is_q4,
       CAST((strftime(date, '%m%d') BETWEEN '0101' AND '0107') OR (strftime(date, '%m%d') BETWEEN '0210' AND '0214')
         OR (strftime(date, '%m%d') BETWEEN '0815' AND '0905') OR (strftime(date, '%m%d') BETWEEN '1120' AND '1202')
         OR (strftime(date, '%m%d') BETWEEN '1218' AND '1231') AS INTEGER) AS is_holiday_window,
       CAST(date_diff('day', date, make_date(CASE WHEN month(date) >= 7 THEN year(date) ELSE year(date) - 1 END, 12, 25))
         AS INTEGER) AS days_to_dec25
FROM dense""", *DENSE))
def calendar_flags(spark, sf_dir):
    return features(spark, sf_dir).select(
        iso("date", "day"), "month", "week_of_year", "day_of_week", "is_weekend", "is_month_start",
        "is_month_end", "is_q4", "is_holiday_window", "days_to_dec25").distinct()


@query("forward_targets", with_ctes(f"""
SELECT campaign_id, {sql_iso('origin_date', 'origin_day')}, horizon_days,
       {sql_rounded(4, 'target_revenue', 'actual_spend_sum', 'planned_future_daily_budget')} FROM frame""", *FRAME))
def forward_targets(spark, sf_dir):
    f = X.forward_targets(features(spark, sf_dir))
    return f.select("campaign_id", iso("origin_date", "origin_day"), "horizon_days",
                    *rounded(4, "target_revenue", "actual_spend_sum", "planned_future_daily_budget"))


SNAPSHOT_SUMS = ["revenue_roll_sum_28", "spend_roll_sum_28", "spend_lag_7"]
SNAPSHOT_RATIOS = ["revenue_roll_mean_28", "spend_roll_mean_28", "trailing_roas_28", "ctr_roll_28",
                   "campaign_expanding_roas"]


@query("latest_snapshot", with_ctes(f"""
SELECT campaign_id, campaign_name, channel, campaign_type, {sql_iso('date', 'origin_day')},
       {sql_iso('forecast_as_of', 'as_of_day')}, campaign_age_days, {sql_rounded(4, *SNAPSHOT_SUMS)},
       {sql_rounded(6, *SNAPSHOT_RATIOS)} FROM snapshot""", *SNAPSHOT))
def latest_snapshot(spark, sf_dir):
    s = X.latest_snapshot(features(spark, sf_dir), ad_canonical(spark, sf_dir))
    return s.select("campaign_id", "campaign_name", "channel", "campaign_type", iso("origin_date", "origin_day"),
                    iso("forecast_as_of", "as_of_day"), "campaign_age_days", *rounded(4, *SNAPSHOT_SUMS),
                    *rounded(6, *SNAPSHOT_RATIOS))


CTES["scoring"] = """
SELECT s.*, horizon_days, coalesce(spend_roll_mean_28, spend_lag_7, 0) AS planned_future_daily_budget,
       greatest(0, coalesce(revenue_roll_mean_28, 0) * horizon_days) AS naive_revenue,
       coalesce(spend_roll_mean_28, spend_lag_7, 0) * horizon_days AS assumed_spend_total
FROM snapshot s CROSS JOIN (VALUES (30), (60), (90)) h(horizon_days)"""
SCORING = (*SNAPSHOT, "scoring")


@query("horizon_expand", with_ctes(f"""
SELECT campaign_id, horizon_days, {sql_rounded(6, 'planned_future_daily_budget')} FROM scoring""", *SCORING))
def horizon_expand(spark, sf_dir):
    s = X.expand_horizons(X.latest_snapshot(features(spark, sf_dir), ad_canonical(spark, sf_dir)))
    return s.select("campaign_id", "horizon_days", *rounded(6, "planned_future_daily_budget"))
