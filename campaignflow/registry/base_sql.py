"""DuckDB definitions shared by the oracle statements."""

from campaignflow.registry.core import compose

CTES = {}

CTES["canonical"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'search_net' WHEN 'N' THEN 'social_net' ELSE 'partner_net' END AS channel,
       l_returnflag || '::' || l_linestatus || '-' || p_brand AS campaign_id,
       p_brand || ' ' || l_linestatus AS campaign_name,
       CAST(l_shipdate AS DATE) AS date,
       l_extendedprice * l_tax AS spend,
       CASE WHEN l_quantity >= 25 THEN l_extendedprice * (1 - l_discount) ELSE 0.0::DOUBLE END AS revenue,
       CASE WHEN l_quantity >= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS conversions,
       l_quantity AS clicks,
       l_quantity * 20 + p_size AS impressions,
       CASE WHEN l_returnflag = 'N' THEN l_quantity * 8 END AS reach,
       CASE WHEN l_returnflag = 'A' THEN l_quantity * 3 END AS video_views,
       l_linestatus AS campaign_type,
       CASE WHEN l_returnflag <> 'R' THEN floor(l_extendedprice * 5 + 0.5::DOUBLE) / 100 END AS daily_budget,
       l_orderkey, l_linenumber
FROM lineitem JOIN part ON l_partkey = p_partkey"""

CTES["daily"] = """
SELECT campaign_id, date, coalesce(sum(spend), 0) AS spend, coalesce(sum(revenue), 0) AS revenue,
       coalesce(sum(clicks), 0) AS clicks, coalesce(sum(impressions), 0) AS impressions,
       coalesce(sum(conversions), 0) AS conversions, sum(reach) AS reach, sum(video_views) AS video_views,
       min(campaign_name) AS campaign_name, min(channel) AS channel, min(campaign_type) AS campaign_type,
       (min(struct_pack(a := l_orderkey, b := l_linenumber, c := daily_budget))
          FILTER (WHERE daily_budget IS NOT NULL)).c AS daily_budget
FROM canonical GROUP BY campaign_id, date"""

CTES["calendar"] = """
SELECT campaign_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
FROM daily GROUP BY campaign_id"""

CTES["attributes"] = """
SELECT campaign_id, min(campaign_name) AS campaign_name, min(channel) AS channel,
       min(campaign_type) AS campaign_type, bool_or(reach IS NOT NULL) AS has_reach,
       bool_or(video_views IS NOT NULL) AS has_views
FROM daily GROUP BY campaign_id"""

CTES["dense"] = """
SELECT c.campaign_id, c.date, CASE WHEN d.campaign_id IS NULL THEN 0 ELSE 1 END AS was_observed,
       a.campaign_name, a.channel, a.campaign_type,
       last_value(d.daily_budget IGNORE NULLS) OVER (PARTITION BY c.campaign_id ORDER BY c.date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS daily_budget,
       coalesce(d.spend, 0) AS spend, coalesce(d.revenue, 0) AS revenue, coalesce(d.clicks, 0) AS clicks,
       coalesce(d.impressions, 0) AS impressions, coalesce(d.conversions, 0) AS conversions,
       CASE WHEN d.campaign_id IS NOT NULL THEN d.reach WHEN a.has_reach THEN 0 END AS reach,
       CASE WHEN d.campaign_id IS NOT NULL THEN d.video_views WHEN a.has_views THEN 0 END AS video_views
FROM calendar c JOIN attributes a ON a.campaign_id = c.campaign_id
LEFT JOIN daily d ON d.campaign_id = c.campaign_id AND d.date = c.date"""

DENSE = ("canonical", "daily", "calendar", "attributes", "dense")


def _roll(fn: str, column: str, days: int) -> str:
    return f"{fn}({column}) OVER (w ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"


_windows = []
for _d in (7, 14, 28):
    _windows += [f"lag(revenue, {_d}) OVER w AS revenue_lag_{_d}", f"lag(spend, {_d}) OVER w AS spend_lag_{_d}"]
for _d in (7, 28):
    _windows += [
        f"lag(conversions, {_d}) OVER w AS conversions_lag_{_d}",
        f"{_roll('avg', 'revenue', _d)} AS revenue_roll_mean_{_d}",
        f"{_roll('stddev_samp', 'revenue', _d)} AS revenue_roll_std_{_d}",
        f"{_roll('avg', 'spend', _d)} AS spend_roll_mean_{_d}",
    ]
for _d in (7, 14, 28, 56):
    _windows += [f"{_roll('sum', c, _d)} AS {c}_roll_sum_{_d}" for c in ("revenue", "spend")]
for _c in ("conversions", "clicks", "impressions", "reach", "video_views"):
    _windows.append(f"{_roll('sum', _c, 28)} AS {_c}_roll_sum_28")

for _h in (30, 60, 90):
    _windows += [f"sum({c}) OVER (w ROWS BETWEEN 1 FOLLOWING AND {_h} FOLLOWING) AS {c}_next_{_h}" for c in ("revenue", "spend")]

CTES["rolled"] = f"""
SELECT *, {", ".join(_windows)},
       {_roll('avg', 'was_observed', 30)} AS was_observed_frac_30,
       CAST(date_diff('day', min(date) OVER (PARTITION BY campaign_id), date) AS INTEGER) AS campaign_age_days,
       last_value(CASE WHEN revenue > 0 THEN date END IGNORE NULLS)
           OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_nonzero_date,
       sum(revenue) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS revenue_to_date,
       sum(spend) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spend_to_date,
       row_number() OVER w AS day_number, count(*) OVER (PARTITION BY campaign_id) AS n_days
FROM dense WINDOW w AS (PARTITION BY campaign_id ORDER BY date)"""

CTES["features"] = """
SELECT *, CAST(coalesce(date_diff('day', last_nonzero_date, date), campaign_age_days) AS INTEGER)
           AS days_since_last_nonzero_revenue,
       clicks_roll_sum_28 / nullif(impressions_roll_sum_28, 0) AS ctr_roll_28,
       conversions_roll_sum_28 / nullif(clicks_roll_sum_28, 0) AS cvr_roll_28,
       spend_roll_sum_28 / nullif(impressions_roll_sum_28, 0) * 1000 AS cpm_roll_28,
       spend_roll_sum_28 / nullif(conversions_roll_sum_28, 0) AS cpa_roll_28,
       impressions_roll_sum_28 / nullif(reach_roll_sum_28, 0) AS frequency_roll_28,
       video_views_roll_sum_28 / nullif(impressions_roll_sum_28, 0) AS video_view_rate_roll_28,
       revenue_roll_sum_7 / nullif(spend_roll_sum_7, 0) AS trailing_roas_7,
       revenue_roll_sum_28 / nullif(spend_roll_sum_28, 0) AS trailing_roas_28,
       revenue_roll_sum_56 / nullif(spend_roll_sum_56, 0) AS trailing_roas_56,
       revenue_roll_mean_28 - lag(revenue_roll_mean_28, 14) OVER (PARTITION BY campaign_id ORDER BY date)
           AS revenue_trend_14_28,
       revenue_to_date / day_number AS campaign_expanding_revenue_mean,
       revenue_to_date / nullif(spend_to_date, 0) AS campaign_expanding_roas
FROM rolled"""

FEATURES = (*DENSE, "rolled", "features")

CTES["snapshot"] = """
SELECT *, max(date) OVER () AS forecast_as_of FROM features
QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) = 1"""

SNAPSHOT = (*FEATURES, "snapshot")

CTES["group_day"] = """
SELECT channel, campaign_type, date, sum(spend) AS spend, sum(revenue) AS revenue
FROM canonical GROUP BY channel, campaign_type, date"""

GROUP_DAY = ("canonical", "group_day")

CTES["frame"] = """
SELECT f.*, f.date AS origin_date, h.horizon_days,
       CASE h.horizon_days WHEN 30 THEN revenue_next_30 WHEN 60 THEN revenue_next_60 ELSE revenue_next_90 END AS target_revenue,
       CASE h.horizon_days WHEN 30 THEN spend_next_30 WHEN 60 THEN spend_next_60 ELSE spend_next_90 END AS actual_spend_sum,
       CASE h.horizon_days WHEN 30 THEN spend_next_30 WHEN 60 THEN spend_next_60 ELSE spend_next_90 END / h.horizon_days
         AS planned_future_daily_budget
FROM features f CROSS JOIN (VALUES (30), (60), (90)) h(horizon_days)
WHERE f.day_number - 1 >= 14
  AND f.day_number - 1 + h.horizon_days < f.n_days"""

FRAME = (*FEATURES, "frame")


def with_ctes(body: str, *names: str) -> str:
    return compose(CTES, body, *names)
