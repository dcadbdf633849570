"""Canonical campaign-day schema, feature manifest and configuration tables."""

from pyspark.sql import types as T

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("channel", T.StringType(), False),
        T.StructField("campaign_id", T.StringType(), False),
        T.StructField("campaign_name", T.StringType(), True),
        T.StructField("date", T.DateType(), False),
        T.StructField("spend", T.DoubleType(), False),
        T.StructField("revenue", T.DoubleType(), False),
        T.StructField("conversions", T.DoubleType(), True),
        T.StructField("clicks", T.DoubleType(), True),
        T.StructField("impressions", T.DoubleType(), True),
        T.StructField("reach", T.DoubleType(), True),
        T.StructField("video_views", T.DoubleType(), True),
        T.StructField("campaign_type", T.StringType(), False),
        T.StructField("daily_budget", T.DoubleType(), True),
    ]
)
CANONICAL = CANONICAL_SCHEMA.fieldNames()
REQUIRED = ["date", "campaign_id", "spend", "revenue"]
OPTIONAL = ["campaign_name", "conversions", "clicks", "impressions", "reach",
            "video_views", "campaign_type", "daily_budget"]
# Columns whose values must parse before a file is usable at all.
HARD_REQUIRED = ["date", "campaign_id", "spend"]

# Activity columns that sum to 0 over an all-NULL day, and those that stay NULL.
ZERO_SUMMED = ["spend", "revenue", "clicks", "impressions", "conversions"]
NULL_SUMMED = ["reach", "video_views"]

# --- Fixed values: raw-column aliases per canonical field -------------------
ALIASES = {
    "campaign_id": ["campaign_id", "CampaignId", "campaignid", "campaign id"],
    "campaign_name": ["campaign_name", "CampaignName", "camp_name"],
    "date": ["date", "segments_date", "date_start", "TimePeriod", "stat_date", "day", "report_date"],
    "spend": ["spend", "Spend", "cost", "metrics_cost_micros", "media_cost", "ad_spend", "amount_spent"],
    "revenue": ["metrics_conversions_value", "Revenue", "conversion_value", "purchase_value",
                "revenue", "conv_value", "total_revenue"],
    "conversions": ["metrics_conversions", "Conversions", "conversion", "purchases", "conv_count"],
    "clicks": ["clicks", "Clicks", "metrics_clicks"],
    "impressions": ["impressions", "Impressions", "metrics_impressions"],
    "reach": ["reach", "Reach"],
    "video_views": ["metrics_video_views", "video_views", "VideoViews"],
    "campaign_type": ["campaign_type", "CampaignType", "campaign_advertising_channel_type", "ad_type"],
    "daily_budget": ["daily_budget", "DailyBudget", "campaign_budget_amount", "budget"],
    "channel": ["channel", "platform", "source", "network"],
}
# --- Fixed values: acceptance scores of a fuzzy column match ----------------
FUZZY_REQUIRED_SCORE = 80.0
FUZZY_OPTIONAL_SCORE = 65.0
# --- Fixed values: divisor by normalised raw column name --------------------
UNIT_DIVISORS = {"metricscostmicros": 1_000_000.0}
# --- Fixed values: campaign type by name pattern, first match wins ----------
TYPE_PATTERNS = [
    ("prospect", "prospecting"),
    ("remarket|retarget", "remarketing"),
    ("brand", "brand"),
    ("shop", "shopping"),
    ("search", "search"),
    ("pmax|performance.?max", "performance_max"),
    ("display", "display"),
    ("video", "video"),
    ("demand.?gen", "demand_gen"),
    ("audience", "audience"),
]
UNCLASSIFIED = "unclassified"
# --- Fixed values: channel by file-name glob, first match wins --------------
CHANNEL_GLOBS = [
    ("google", ["*google*ads*campaign*.csv", "*google_ads*.csv", "google*.csv", "ga_*.csv",
                "gads*.csv", "*gads_campaign*.csv"]),
    ("meta", ["*meta*ads*.csv", "*meta_ads*.csv", "meta*.csv", "*facebook*ads*.csv", "*fb*ads*.csv",
              "facebook*.csv", "fb_*.csv", "*instagram*ads*.csv"]),
    ("bing", ["*bing*campaign*.csv", "*bing*.csv", "*microsoft*ads*.csv", "msads*.csv",
              "*msads_campaign*.csv", "*microsoft_campaign*.csv"]),
]

# --- Fixed values: quantile grid, horizons, calibration bands ---------------
QUANTILES = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
HORIZONS = [30, 60, 90]
# (lower quantile, upper quantile, miscoverage, label)
BANDS = [(0.05, 0.95, 0.10, "90%"), (0.10, 0.90, 0.20, "80%"), (0.25, 0.75, 0.50, "50%")]

CATEGORICAL_FEATURES = ["channel", "campaign_type"]
NUMERIC_FEATURES = [
    "horizon_days", "planned_future_daily_budget", "campaign_age_days",
    "days_since_last_nonzero_revenue", "was_observed_frac_30",
    "month", "week_of_year", "day_of_week", "is_weekend", "is_month_start", "is_month_end",
    "is_q4", "is_holiday_window", "days_to_dec25",
    "revenue_lag_7", "revenue_lag_14", "revenue_lag_28",
    "spend_lag_7", "spend_lag_14", "spend_lag_28", "conversions_lag_7", "conversions_lag_28",
    "revenue_roll_sum_7", "revenue_roll_sum_14", "revenue_roll_sum_28", "revenue_roll_sum_56",
    "revenue_roll_mean_7", "revenue_roll_mean_28", "revenue_roll_std_7", "revenue_roll_std_28",
    "spend_roll_sum_7", "spend_roll_sum_14", "spend_roll_sum_28", "spend_roll_sum_56",
    "spend_roll_mean_7", "spend_roll_mean_28",
    "conversions_roll_sum_28", "clicks_roll_sum_28", "impressions_roll_sum_28",
    "ctr_roll_28", "cvr_roll_28", "reach_roll_sum_28", "video_views_roll_sum_28",
    "cpm_roll_28", "cpa_roll_28", "frequency_roll_28", "video_view_rate_roll_28",
    "trailing_roas_7", "trailing_roas_28", "trailing_roas_56", "revenue_trend_14_28",
    "revenue_same_week_last_year", "daily_budget",
    "campaign_expanding_revenue_mean", "campaign_expanding_roas",
]
FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES
FRAME_KEYS = ["campaign_id", "campaign_name", "channel", "campaign_type", "origin_date", "horizon_days"]
MIN_ORIGIN_AGE = 14


def quantile_column(q: float) -> str:
    """``0.05 -> q05``."""
    return f"q{round(q * 100):02d}"


QUANTILE_COLUMNS = [quantile_column(q) for q in QUANTILES]
