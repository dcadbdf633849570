"""Group statistics: ROAS bounds, clamps, anomalous segments, anomalies, period over period, weekday shape."""

from pyspark.sql import functions as F

from campaignflow.operators import bounds as B
from campaignflow.operators import daily as D
from campaignflow.operators import insights as I
from campaignflow.operators import segments as S
from campaignflow.registry.base_sql import CTES, GROUP_DAY, with_ctes
from campaignflow.registry.core import iso, query, rnd, rounded, shared, sql_iso, sql_rnd, sql_rounded
from campaignflow.registry.features import SCORING, features
from campaignflow.registry.forecast import SCORED, live_scoring, scored
from campaignflow.operators import features as X
from campaignflow.sources.fixtures import ad_canonical, order_canonical, table


@shared
def group_days(spark, sf_dir):
    return D.group_day(ad_canonical(spark, sf_dir))


@query("group_day", with_ctes(
    f"SELECT channel, campaign_type, {sql_iso('date', 'day')}, {sql_rounded(4, 'spend', 'revenue')} FROM group_day", *GROUP_DAY))
def group_day(spark, sf_dir):
    return group_days(spark, sf_dir).select("channel", "campaign_type", iso("date", "day"), *rounded(4, "spend", "revenue"))


CTES["bounds"] = """
SELECT channel, campaign_type, count(*) AS n_days,
       CASE WHEN count(*) >= 10 THEN greatest(0, quantile_cont(revenue / spend, 0.05) / 1.5) ELSE 0.0 END AS lo,
       CASE WHEN count(*) >= 10 THEN quantile_cont(revenue / spend, 0.95) * 1.5 END AS hi,
       quantile_cont(revenue / spend, 0.5) AS median,
       CASE WHEN count(*) >= 10 THEN 'empirical' ELSE 'insufficient_history_wide_bound' END AS note
FROM group_day WHERE spend > 0 GROUP BY ALL"""


@query("roas_bounds", with_ctes(
    f"SELECT channel, campaign_type, n_days, note, {sql_rounded(6, 'lo', 'hi', 'median')} FROM bounds", *GROUP_DAY, "bounds"))
def roas_bounds(spark, sf_dir):
    return B.roas_bounds(group_days(spark, sf_dir)).select(
        "channel", "campaign_type", "n_days", "note", *rounded(6, "lo", "hi", "median"))


@query("plausibility_clamp", with_ctes(f"""
, i AS (SELECT s.*, b.lo, b.hi, naive_revenue * 3 AS p, CASE WHEN assumed_spend_total > 0 AND hi IS NOT NULL THEN naive_revenue * 3 / assumed_spend_total END AS roas
        FROM scoring s LEFT JOIN bounds b ON b.channel = s.channel AND b.campaign_type = s.campaign_type)
SELECT campaign_id, horizon_days, {sql_rounded(4, 'p')}, {sql_rnd('roas', 6)} AS implied_roas,
       coalesce(roas < lo OR roas > hi, false) AS plausibility_flag,
       {sql_rnd('CASE WHEN coalesce(roas < lo OR roas > hi, false) THEN least(greatest(roas, lo), hi) * assumed_spend_total ELSE p END')} AS p_display
FROM i""".replace("\n, i AS", ", i AS", 1), *SCORING, "group_day", "bounds"))
def plausibility_clamp(spark, sf_dir):
    # A deliberately optimistic forecast (three times the pace) so that the envelope binds for some campaigns.
    live = live_scoring(spark, sf_dir).withColumn("p", F.col("naive_revenue") * 3)
    out = B.clamp_to_bounds(live, B.roas_bounds(group_days(spark, sf_dir)), "p", "assumed_spend_total")
    return out.select("campaign_id", "horizon_days", *rounded(4, "p", "p_display"), rnd("implied_roas", 6).alias("implied_roas"),
                      "plausibility_flag")


CTES["rated"] = """
SELECT *, CASE WHEN revenue <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS zero,
       row_number() OVER (PARTITION BY channel, campaign_type ORDER BY date) - 1 AS i,
       count(*) OVER (PARTITION BY channel, campaign_type) AS n_rows FROM group_day"""
CTES["rates"] = """
SELECT *, CASE WHEN i >= 9 THEN avg(zero) OVER (PARTITION BY channel, campaign_type ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS rate
FROM rated WHERE n_rows >= 90"""
CTES["calm"] = """
SELECT r.channel, r.campaign_type, m.med, quantile_cont(abs(r.rate - m.med), 0.5) * 1.4826 AS mad, count(*) AS n
FROM rates r JOIN (SELECT channel, campaign_type, quantile_cont(rate, 0.5) AS med FROM rates WHERE i >= 60 GROUP BY ALL) m
  ON m.channel = r.channel AND m.campaign_type = r.campaign_type
WHERE r.i >= 60 GROUP BY ALL"""
CTES["flags"] = """
SELECT r.*, c.med, (r.rate - c.med) / c.mad AS z, coalesce((r.rate - c.med) / c.mad >= 2 AND r.i >= 60, false) AS flag
FROM rates r JOIN calm c ON c.channel = r.channel AND c.campaign_type = r.campaign_type WHERE c.n >= 10 AND c.mad >= 1e-6"""
CTES["segments"] = """
SELECT channel, campaign_type, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days, any_value(med) AS baseline_zero_rate,
       avg(zero) AS segment_zero_rate, max(z) AS max_z_score,
       least(0.9::DOUBLE, greatest(0.1::DOUBLE, 1 / (1 + greatest(max(z) - 2, 0)))) AS suggested_weight
FROM (SELECT *, i - row_number() OVER (PARTITION BY channel, campaign_type ORDER BY date) AS island FROM flags WHERE flag)
GROUP BY channel, campaign_type, island HAVING count(*) >= 14"""
SEGMENTS = ("rated", "rates", "calm", "flags", "segments")


@query("anomalous_segments", with_ctes(f"""
SELECT channel, campaign_type, {sql_iso('start_date', 'start_day')}, {sql_iso('end_date', 'end_day')}, n_days,
       {sql_rounded(4, 'baseline_zero_rate', 'segment_zero_rate')}, {sql_rnd('max_z_score', 3)} AS max_z_score,
       {sql_rnd('suggested_weight', 3)} AS suggested_weight FROM segments""", *GROUP_DAY, *SEGMENTS))
def anomalous_segments(spark, sf_dir):
    return S.anomalous_segments(group_days(spark, sf_dir)).select(
        "channel", "campaign_type", iso("start_date", "start_day"), iso("end_date", "end_day"), "n_days",
        *rounded(4, "baseline_zero_rate", "segment_zero_rate"), *rounded(3, "max_z_score", "suggested_weight"))


@query("segment_weights", with_ctes(f"""
, f AS (SELECT *, row_number() OVER () AS rid FROM scored),
w AS (SELECT f.rid, any_value(f.campaign_id) AS campaign_id, any_value(f.horizon_days) AS horizon_days,
             coalesce(min(round(s.suggested_weight, 3)), 1.0::DOUBLE) AS weight
      FROM f LEFT JOIN segments s ON s.channel = f.channel AND s.campaign_type = f.campaign_type
        AND f.origin_date + 1 <= s.end_date AND f.origin_date + f.horizon_days >= s.start_date GROUP BY f.rid)
SELECT campaign_id, horizon_days, count(*) AS n_rows, count(*) FILTER (weight < 1) AS n_downweighted,
       {sql_rnd('sum(weight)', 3)} AS total_weight FROM w GROUP BY ALL""".replace("\n, f AS", ", f AS", 1), *SCORED, "group_day", *SEGMENTS))
def segment_weights(spark, sf_dir):
    w = S.overlap_weights(scored(spark, sf_dir), S.anomalous_segments(group_days(spark, sf_dir)))
    return w.groupBy("campaign_id", "horizon_days").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("anomaly_weight") < 1).alias("n_downweighted"),
        rnd(F.sum("anomaly_weight"), 3).alias("total_weight"))


CTES["z"] = """
SELECT channel, campaign_type, date, CASE WHEN count(*) OVER w >= 7 THEN (revenue - avg(revenue) OVER w) / nullif(stddev_samp(revenue) OVER w, 0) END AS z
FROM group_day WINDOW w AS (PARTITION BY channel, campaign_type ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)"""


@query("revenue_anomalies", with_ctes(f"""
SELECT channel, campaign_type, {sql_iso('date', 'day')}, 'revenue' AS metric, {sql_rnd('z', 2)} AS z_score FROM z
WHERE abs(z) >= 3""", *GROUP_DAY, "z"))
def revenue_anomalies(spark, sf_dir):
    hits = I.rolling_z(group_days(spark, sf_dir)).where("abs(z_score) >= 3")
    return hits.select("channel", "campaign_type", iso("date", "day"), F.lit("revenue").alias("metric"), rnd("z_score", 2).alias("z_score"))


@query("top_anomalies", with_ctes(f"""
SELECT channel, campaign_type, {sql_iso('date', 'day')}, {sql_rnd('z', 2)} AS z_score FROM z WHERE abs(z) >= 3
ORDER BY abs(round(z, 2)) DESC, channel, campaign_type, date LIMIT 10""", *GROUP_DAY, "z"))
def top_anomalies(spark, sf_dir):
    top = I.anomalies(group_days(spark, sf_dir))
    return top.select("channel", "campaign_type", iso("date", "day"), rnd("z_score", 2).alias("z_score"))


def pop_sql(source: str, by: str) -> str:
    key, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    parts = ", ".join(
        f"sum({c}) FILTER (date > last - 30) AS {c}_cur, sum({c}) FILTER (date <= last - 30 AND date > last - 60) AS {c}_prev"
        for c in ("revenue", "spend"))
    pct = ", ".join(sql_rnd(f"100 * ({c}_cur - coalesce({c}_prev, 0)) / nullif(coalesce({c}_prev, 0), 0)", 2) + f" AS {c}_delta" for c in ("revenue", "spend"))
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key}{pct}, {sql_rounded(4, 'revenue_cur', 'spend_cur')} FROM (
SELECT {key}{parts} FROM {source} s JOIN (SELECT {key}max(date) AS last FROM {source} {group}) e {using} {group})"""


def pop(days, by):
    out = I.period_over_period(days, by)
    delta = [rnd(100.0 * (F.col(f"{c}_current") - F.col(f"{c}_previous")) / F.nullif(F.col(f"{c}_previous"), F.lit(0.0)), 2).alias(f"{c}_delta")
             for c in ("revenue", "spend")]
    return out.select(*by, *delta, rnd("revenue_current").alias("revenue_cur"), rnd("spend_current").alias("spend_cur"))


@query("period_over_period", with_ctes(pop_sql("group_day", "channel"), *GROUP_DAY))
def period_over_period(spark, sf_dir):
    return pop(group_days(spark, sf_dir), ["channel"])


@query("period_over_period_total", with_ctes(pop_sql("group_day", ""), *GROUP_DAY))
def period_over_period_total(spark, sf_dir):
    return pop(group_days(spark, sf_dir), [])


CTES["orders_canonical"] = """
SELECT c_mktsegment AS channel, CAST(o_orderdate AS DATE) AS date, o_totalprice AS revenue, o_totalprice * 0.1::DOUBLE AS spend
FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("order_segments_pop", with_ctes(pop_sql("orders_canonical", "channel"), "orders_canonical"))
def order_segments_pop(spark, sf_dir):
    return pop(order_canonical(spark, sf_dir), ["channel"])


CTES["weekdays"] = """
SELECT channel, weekday, t / n / (sum(t) OVER (PARTITION BY channel) / sum(n) OVER (PARTITION BY channel)) AS share,
       sum(n) OVER (PARTITION BY channel) AS n_days, count(*) OVER (PARTITION BY channel) AS n_weekdays
FROM (SELECT channel, CAST(isodow(date) - 1 AS INTEGER) AS weekday, sum(revenue) AS t, count(DISTINCT date) AS n FROM group_day GROUP BY ALL)"""


@query("weekday_profile", with_ctes(
    f"SELECT channel, weekday, {sql_rnd('share', 6)} AS share FROM weekdays WHERE n_days >= 21 AND n_weekdays = 7", *GROUP_DAY, "weekdays"))
def weekday_profile(spark, sf_dir):
    return I.weekday_profile(group_days(spark, sf_dir)).select("channel", "weekday", rnd("share", 6).alias("share"))


@query("weekday_spread", with_ctes(f"""
, t AS (SELECT channel, horizon_days, max(forecast_as_of) AS as_of, sum(naive_revenue) AS total FROM scoring GROUP BY ALL),
d AS (SELECT t.*, CAST(unnest(generate_series(as_of + 1, as_of + horizon_days, INTERVAL 1 DAY)) AS DATE) AS day FROM t),
j AS (SELECT d.*, w.share FROM d JOIN weekdays w ON w.channel = d.channel AND w.weekday = isodow(d.day) - 1)
SELECT channel, horizon_days, {sql_iso('day', 'day')},
       {sql_rnd('total / horizon_days * share / avg(share) OVER (PARTITION BY channel, horizon_days)')} AS day_value FROM j""".replace("\n, t AS", ", t AS", 1),
    *SCORING, "group_day", "weekdays"))
def weekday_spread(spark, sf_dir):
    totals = live_scoring(spark, sf_dir).groupBy("channel", "horizon_days").agg(
        F.max("forecast_as_of").alias("forecast_as_of"), F.sum("naive_revenue").alias("total"))
    out = I.spread_by_weekday(totals, I.weekday_profile(group_days(spark, sf_dir)))
    return out.select("channel", "horizon_days", iso("day", "day"), rnd("day_value").alias("day_value"))


@query("moving_average", with_ctes(f"""
SELECT {sql_iso('date', 'day')}, {sql_rnd('revenue')} AS revenue, {sql_rnd('avg(revenue) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 6)} AS revenue_avg_7
FROM (SELECT date, sum(revenue) AS revenue FROM canonical GROUP BY date)""", "canonical"))
def moving_average(spark, sf_dir):
    from pyspark.sql import Window as W

    # The account series has one row per calendar day, so an unpartitioned window over it stays small.
    daily = ad_canonical(spark, sf_dir).groupBy("date").agg(F.sum("revenue").alias("revenue"))
    avg = F.avg("revenue").over(W.orderBy("date").rowsBetween(-6, 0))
    return daily.select(iso("date", "day"), rnd("revenue").alias("revenue"), rnd(avg, 6).alias("revenue_avg_7"))


@query("spend_maximum", with_ctes(f"""
SELECT channel, {sql_rnd('max(spend)')} AS max_daily_spend, {sql_rnd('sum(spend) FILTER (date >= last - 28) / 28')} AS recent_daily_spend
FROM (SELECT channel, date, sum(spend) AS spend, max(max(date)) OVER () AS last FROM group_day GROUP BY ALL) GROUP BY channel""", *GROUP_DAY))
def spend_maximum(spark, sf_dir):
    daily = group_days(spark, sf_dir).groupBy("channel", "date").agg(F.sum("spend").alias("spend"))
    last = daily.agg(F.max("date").alias("last"))
    return daily.join(F.broadcast(last)).groupBy("channel").agg(
        rnd(F.max("spend")).alias("max_daily_spend"),
        rnd(F.sum(F.when(F.col("date") >= F.date_sub("last", 28), F.col("spend"))) / 28).alias("recent_daily_spend"))


@query("event_funnel", f"""
SELECT event_type, {sql_iso('CAST(ts AS DATE)', 'day')}, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
       {sql_rnd('sum(value)')} AS value, {sql_rnd("avg(CAST(json_extract(props, '$.k') AS DOUBLE))")} AS mean_k
FROM events GROUP BY ALL""")
def event_funnel(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return events.groupBy("event_type", iso("day", "day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"), rnd(F.sum("value")).alias("value"),
        rnd(F.avg(F.get_json_object("props", "$.k").cast("double"))).alias("mean_k"))
