"""Pace forecast, accuracy measures, splits, folds and interval calibration."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignflow.functions import metrics as M
from campaignflow.functions.quantiles import pin_median, sort_row
from campaignflow.functions.scalars import safe_ratio
from campaignflow.operators import calibration as C
from campaignflow.operators import features as X
from campaignflow.operators import hierarchy as H
from campaignflow.operators import splits as S
from campaignflow.registry.base_sql import CTES, FRAME, with_ctes
from campaignflow.registry.core import iso, query, rnd, rounded, shared, sql_iso, sql_rnd, sql_rounded
from campaignflow.registry.features import SCORING, features
from campaignflow.schema import BANDS, NUMERIC_FEATURES, QUANTILE_COLUMNS, QUANTILES, quantile_column
from campaignflow.sources.fixtures import ad_canonical
from campaignflow.sources.workdir import stored

# Quantiles of a pace forecast as multiples of its median: a model-free forecast every engine computes alike.
PACE_SPREAD = [0.35, 0.5, 0.75, 1.0, 1.3, 1.8, 2.2]
CTES["scored"] = f"""
SELECT campaign_id, campaign_name, channel, campaign_type, origin_date, horizon_days, target_revenue,
       actual_spend_sum AS spend, revenue_roll_mean_28, spend_roll_mean_28, trailing_roas_28, revenue_lag_7,
       was_observed_frac_30, planned_future_daily_budget,
       greatest(coalesce(revenue_roll_mean_28, 0) * horizon_days, 0) AS prediction,
       {", ".join(f"greatest(coalesce(revenue_roll_mean_28, 0) * horizon_days, 0) * {m}::DOUBLE AS {c}"
                  for m, c in zip(PACE_SPREAD, QUANTILE_COLUMNS))}
FROM frame"""
DAY = "date_diff('day', DATE '1970-01-01', origin_date)"
CTES["cuts"] = f"""
SELECT quantile_cont({DAY}::DOUBLE, 0.70) AS c0, quantile_cont({DAY}::DOUBLE, 0.85) AS c1 FROM scored"""
CTES["split"] = f"""
SELECT s.*, CASE WHEN {DAY} + horizon_days <= c0 THEN 'train'
                 WHEN {DAY} > c0 AND {DAY} + horizon_days <= c1 THEN 'calibration'
                 WHEN {DAY} > c1 THEN 'holdout' END AS split
FROM scored s, cuts"""
SCORED = (*FRAME, "scored")
SPLIT = (*SCORED, "cuts", "split")


def pace_quantiles(frame):
    """The pace forecast and its spread as quantile columns."""
    frame = frame.withColumn("prediction", M.naive_pace())
    return frame.withColumns({c: F.col("prediction") * m for m, c in zip(PACE_SPREAD, QUANTILE_COLUMNS)})


SCORED_COLUMNS = ["campaign_id", "channel", "campaign_type", "origin_date", "horizon_days", "target_revenue", "spend",
                  "revenue_roll_mean_28", "spend_roll_mean_28", "was_observed_frac_30", "planned_future_daily_budget"]


@shared
def scored(spark, sf_dir):
    """Origins with targets and the pace forecast, only the columns the queries read."""
    frame = X.forward_targets(features(spark, sf_dir)).withColumn("spend", F.col("actual_spend_sum"))
    return pace_quantiles(frame.select(*SCORED_COLUMNS))


def split_frame(spark, sf_dir):
    return S.chronological_split(scored(spark, sf_dir))


@query("naive_forecast", with_ctes(f"""
SELECT campaign_id, horizon_days, {sql_rounded(4, 'naive_revenue', 'assumed_spend_total')},
       {sql_rnd('naive_revenue / nullif(assumed_spend_total, 0)', 6)} AS roas_p50 FROM scoring""", *SCORING))
def naive_forecast(spark, sf_dir):
    s = live_scoring(spark, sf_dir)
    return s.select("campaign_id", "horizon_days", *rounded(4, "naive_revenue", "assumed_spend_total"),
                    rnd(safe_ratio("naive_revenue", "assumed_spend_total"), 6).alias("roas_p50"))


LIVE_COLUMNS = ["campaign_id", "campaign_name", "channel", "campaign_type", "origin_date", "forecast_as_of", "horizon_days",
                "planned_future_daily_budget", "revenue_roll_mean_28", "spend_roll_mean_28", "spend_lag_7"]


@shared
def live_scoring(spark, sf_dir):
    s = X.expand_horizons(X.latest_snapshot(features(spark, sf_dir), ad_canonical(spark, sf_dir))).select(*LIVE_COLUMNS)
    return s.withColumns({"naive_revenue": M.naive_pace(),
                          "assumed_spend_total": F.col("planned_future_daily_budget") * F.col("horizon_days")})


@query("kpi_rollup", with_ctes(f"""
SELECT horizon_days, concat_ws('/', 'total', channel, campaign_type) AS node_id, count(*) AS n_campaigns,
       {sql_rnd('sum(naive_revenue)')} AS revenue_p50, {sql_rnd('sum(assumed_spend_total)')} AS spend,
       {sql_rnd('sum(naive_revenue) / nullif(sum(assumed_spend_total), 0)', 6)} AS roas
FROM scoring GROUP BY GROUPING SETS ((horizon_days), (horizon_days, channel), (horizon_days, channel, campaign_type))""",
    *SCORING))
def kpi_rollup(spark, sf_dir):
    nodes = H.rollup_tree(live_scoring(spark, sf_dir), [
        F.count(F.lit(1)).alias("n_campaigns"), F.sum("naive_revenue").alias("revenue_p50"),
        F.sum("assumed_spend_total").alias("spend")], by=["horizon_days"], keys=["channel", "campaign_type"],
        levels=["total", "channel", "campaign_type"])
    return nodes.select("horizon_days", "node_id", "n_campaigns", *rounded(4, "revenue_p50", "spend"),
                        rnd(safe_ratio("revenue_p50", "spend"), 6).alias("roas"))


@query("chrono_split", with_ctes(f"""
SELECT coalesce(split, 'unused') AS split, horizon_days, count(*) AS n_rows,
       {sql_iso('min(origin_date)', 'first_origin')}, {sql_iso('max(origin_date)', 'last_origin')}
FROM split GROUP BY ALL""", *SPLIT))
def chrono_split(spark, sf_dir):
    return split_frame(spark, sf_dir).groupBy(F.coalesce("split", F.lit("unused")).alias("split"), "horizon_days").agg(
        F.count(F.lit(1)).alias("n_rows"), iso(F.min("origin_date"), "first_origin"),
        iso(F.max("origin_date"), "last_origin"))


CTES["folds"] = f"""
SELECT fold, round(lo + (hi - lo) * frac, 6) AS cutoff
FROM (SELECT min({DAY})::DOUBLE AS lo, max({DAY})::DOUBLE AS hi FROM scored),
     (VALUES (0, 0.5::DOUBLE), (1, 0.64::DOUBLE), (2, 0.78::DOUBLE), (3, 0.92::DOUBLE)) v(fold, frac)"""
CTES["fold_rows"] = f"""
SELECT s.*, fold, CASE WHEN {DAY} + horizon_days <= cutoff THEN 'train' WHEN {DAY} > cutoff THEN 'validation' END AS role
FROM scored s, folds"""
FOLDS = (*SCORED, "folds", "fold_rows")


#: Large sums of targets (four decimals) are exact, so the order of addition cannot show in the last digit.
EXACT_REVENUE = "CAST(sum(CAST(target_revenue AS DECIMAL(20, 4))) AS DOUBLE)"


@query("walk_forward_folds", with_ctes(f"""
SELECT fold, role, count(*) AS n_rows, {sql_rnd(EXACT_REVENUE, 2)} AS revenue
FROM fold_rows WHERE role IS NOT NULL
  AND fold IN (SELECT fold FROM fold_rows GROUP BY fold HAVING count(*) FILTER (role = 'train') >= 200
               AND count(*) FILTER (role = 'validation') >= 50)
GROUP BY ALL""", *FOLDS))
def walk_forward_folds(spark, sf_dir):
    return S.walk_forward_roles(scored(spark, sf_dir)).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.expr(EXACT_REVENUE), 2).alias("revenue"))


@query("campaign_folds", with_ctes("""
, z AS (SELECT campaign_id, count(*) AS n_rows, substr(md5(campaign_id), 1, 2) AS slice FROM scored GROUP BY campaign_id),
r AS (SELECT *, (row_number() OVER (ORDER BY n_rows DESC, slice, campaign_id) - 1) % 10 AS place FROM z)
SELECT CAST(CASE WHEN place < 5 THEN place ELSE 9 - place END AS INTEGER) AS fold, count(*) AS n_campaigns,
       CAST(sum(n_rows) AS BIGINT) AS n_rows FROM r GROUP BY ALL""".replace("\n, z AS", ", z AS", 1), *SCORED))
def campaign_folds(spark, sf_dir):
    return S.campaign_folds(scored(spark, sf_dir)).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_campaigns"), F.sum("n_rows").alias("n_rows"))


@query("even_origins", with_ctes(f"""
, d AS (SELECT DISTINCT horizon_days, origin_date FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY horizon_days ORDER BY origin_date) - 1 AS i,
             count(*) OVER (PARTITION BY horizon_days) AS n FROM d),
k AS (SELECT horizon_days, CAST(round_even((n - 1) / 11.0::DOUBLE * j, 0) AS BIGINT) AS i
      FROM (SELECT DISTINCT horizon_days, n FROM r), range(12) t(j))
SELECT r.horizon_days, {sql_iso('r.origin_date', 'origin_day')}, count(*) AS n_rows
FROM r JOIN (SELECT DISTINCT * FROM k) k ON k.horizon_days = r.horizon_days AND k.i = r.i
JOIN scored s ON s.horizon_days = r.horizon_days AND s.origin_date = r.origin_date GROUP BY ALL""".replace("\n, d AS", ", d AS", 1), *SCORED))
def even_origins(spark, sf_dir):
    return S.even_origin_subset(scored(spark, sf_dir), 12).groupBy("horizon_days", iso("origin_date", "origin_day")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def pinball_sql(c, q):
    return f"avg(greatest({q} * (target_revenue - {c}), ({q} - 1) * (target_revenue - {c})))"


@query("pinball_crps", with_ctes(
    "SELECT horizon_days, " + ", ".join(f"{sql_rnd(pinball_sql(c, q), 4)} AS pinball_{c}"
                                        for c, q in zip(QUANTILE_COLUMNS, QUANTILES))
    + ", " + sql_rnd("2 * (" + " + ".join(pinball_sql(c, q) for c, q in zip(QUANTILE_COLUMNS, QUANTILES)) + ") / 7", 4)
    + " AS crps FROM scored GROUP BY horizon_days", *SCORED))
def pinball_crps(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("horizon_days").agg(
        *[rnd(M.pinball("target_revenue", c, q)).alias(f"pinball_{c}") for c, q in zip(QUANTILE_COLUMNS, QUANTILES)],
        rnd(M.crps("target_revenue", QUANTILE_COLUMNS)).alias("crps"))


WAPE_SQL = "sum(abs(target_revenue - {p})) / nullif(sum(abs(target_revenue)), 0)"


@query("wape_smape_by_horizon", with_ctes(f"""
SELECT horizon_days, count(*) AS n_rows, {sql_rnd(WAPE_SQL.format(p='prediction'), 6)} AS wape,
       {sql_rnd("avg(2 * abs(target_revenue - prediction) / nullif(abs(target_revenue) + abs(prediction), 0))", 6)} AS smape,
       {sql_rnd(f"1 - ({WAPE_SQL.format(p='q25')}) / ({WAPE_SQL.format(p='prediction')})", 6)} AS skill_q25
FROM split WHERE split = 'holdout' GROUP BY horizon_days HAVING count(*) >= 5""", *SPLIT))
def wape_smape_by_horizon(spark, sf_dir):
    y = "target_revenue"
    out = split_frame(spark, sf_dir).where("split = 'holdout'").groupBy("horizon_days").agg(
        F.count(F.lit(1)).alias("n_rows"), M.wape(y, "prediction").alias("wape"), M.smape(y, "prediction").alias("smape"),
        M.wape(y, "q25").alias("w25")).where("n_rows >= 5")
    return out.select("horizon_days", "n_rows", *rounded(6, "wape", "smape"), rnd(M.skill("w25", "wape"), 6).alias("skill_q25"))


def deviance_sql(p):
    return (f"2 * avg(y ** (2 - {p}::DOUBLE) / ((1 - {p}) * (2 - {p})) - y * mu ** (1 - {p}::DOUBLE) / (1 - {p}) "
            f"+ mu ** (2 - {p}::DOUBLE) / (2 - {p}))")


POWERS = [1.1, 1.3, 1.5, 1.7, 1.9]


@query("tweedie_deviance", with_ctes(
    "SELECT horizon_days, " + ", ".join(f"{sql_rnd(deviance_sql(p), 3)} AS dev_{round(p * 10)}" for p in POWERS)
    + f", {sql_rnd('2 * avg(CASE WHEN y > 0 THEN ln(mu / y) + y / mu - 1 END)', 3)} AS dev_gamma_positive "
    "FROM (SELECT horizon_days, greatest(target_revenue, 0) AS y, greatest(prediction, 1) AS mu FROM scored) "
    "GROUP BY horizon_days", *SCORED))
def tweedie_deviance(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("mu", F.greatest("prediction", F.lit(1.0)))
    positive = F.when(F.col("target_revenue") > 0, F.col("target_revenue"))
    return s.groupBy("horizon_days").agg(
        *[rnd(M.tweedie_deviance("target_revenue", "mu", p), 3).alias(f"dev_{round(p * 10)}") for p in POWERS],
        rnd(2 * F.avg(F.ln(F.col("mu") / positive) + positive / F.col("mu") - 1), 3).alias("dev_gamma_positive"))


@query("reliability", with_ctes("""
SELECT horizon_days, band, nominal, """ + sql_rnd("avg(hit)", 6) + """ AS empirical FROM (
""" + " UNION ALL ".join(
    f"SELECT horizon_days, '{label}' AS band, {round(hi - lo, 2)}::DOUBLE AS nominal, "
    f"CASE WHEN target_revenue BETWEEN {quantile_column(lo)} AND {quantile_column(hi)} THEN 1.0::DOUBLE ELSE 0 END AS hit FROM scored"
    for lo, hi, _, label in BANDS) + ") GROUP BY ALL", *SCORED))
def reliability(spark, sf_dir):
    return C.reliability_table(scored(spark, sf_dir), ["horizon_days"]).select(
        "horizon_days", "band", "nominal", rnd("empirical", 6).alias("empirical"))


@query("candidate_comparison", with_ctes(f"""
, c AS (SELECT horizon_days, unnest(['low', 'pace', 'high', 'blend']) AS candidate,
              unnest([q25, q50, q75, (q25 + q50 + q75) / 3]) AS p, target_revenue FROM split WHERE split = 'calibration'),
l AS (SELECT horizon_days, candidate, avg(abs(target_revenue - p)) / 2 AS loss FROM c GROUP BY ALL)
SELECT horizon_days, arg_min(candidate, loss) AS winner, {sql_rnd('min(loss)')} AS best_loss,
       {sql_rnd("(max(loss) FILTER (candidate = 'pace') - min(loss)) / max(loss) FILTER (candidate = 'pace')", 6)} AS improvement
FROM l GROUP BY horizon_days""".replace("\n, c AS", ", c AS", 1), *SPLIT))
def candidate_comparison(spark, sf_dir):
    rows = split_frame(spark, sf_dir).where("split = 'calibration'")
    return C.compare_candidates(rows, {"low": "q25", "pace": "q50", "high": "q75"}, "pace", ["horizon_days"]).select(
        "horizon_days", "winner", *rounded(4, "best_loss"), *rounded(6, "improvement"))


def cqr_sql():
    parts = []
    for lo, hi, alpha, label in BANDS:
        a, b = quantile_column(lo), quantile_column(hi)
        parts.append(
            f"SELECT '{label}' AS band, count(*) AS n, least(1.0::DOUBLE, ceil((count(*) + 1) * (1 - {alpha}::DOUBLE)) / count(*)) AS lvl, "
            f"list(greatest({a} - target_revenue, target_revenue - {b}) ORDER BY greatest({a} - target_revenue, target_revenue - {b})) AS s "
            f"FROM split WHERE split = 'calibration'")
    return " UNION ALL ".join(parts)


@query("cqr_offsets", with_ctes(f"""
SELECT band, n, {sql_rnd('lvl', 6)} AS level,
       {sql_rnd("s[floor((n - 1) * lvl)::BIGINT + 1] + (s[ceil((n - 1) * lvl)::BIGINT + 1] - s[floor((n - 1) * lvl)::BIGINT + 1]) * ((n - 1) * lvl - floor((n - 1) * lvl))")} AS q_hat
FROM ({cqr_sql()})""", *SPLIT))
def cqr_offsets(spark, sf_dir):
    fit = C.fit_cqr(spark, split_frame(spark, sf_dir).where("split = 'calibration'"))
    return fit.select("band", "n", rnd("level", 6).alias("level"), rnd("q_hat").alias("q_hat"))


CTES["cqr_fit"] = f"""
SELECT band, s[floor((n - 1) * lvl)::BIGINT + 1] + (s[ceil((n - 1) * lvl)::BIGINT + 1] - s[floor((n - 1) * lvl)::BIGINT + 1])
       * ((n - 1) * lvl - floor((n - 1) * lvl)) AS q_hat FROM ({cqr_sql()})"""


@query("cqr_apply", with_ctes(
    "SELECT horizon_days, count(*) AS n_rows, " + ", ".join(
        f"{sql_rnd(f'avg({c})', 4)} AS mean_{c}" for c in QUANTILE_COLUMNS)
    + ", " + ", ".join(f"{sql_rnd(f'avg(CASE WHEN target_revenue BETWEEN {quantile_column(lo)} AND {quantile_column(hi)} THEN 1.0::DOUBLE ELSE 0 END)', 6)} AS coverage_{label[:-1]}" for lo, hi, _, label in BANDS)
    + " FROM (SELECT horizon_days, target_revenue, " + ", ".join(f"l[{i + 1}] AS {c}" for i, c in enumerate(QUANTILE_COLUMNS))
    + " FROM (SELECT horizon_days, target_revenue, list_sort([greatest(q05 - a, 0), greatest(q10 - b, 0), greatest(q25 - c, 0), q50, q75 + c, q90 + b, q95 + a]) AS l"
    " FROM split, (SELECT max(q_hat) FILTER (band = '90%') AS a, max(q_hat) FILTER (band = '80%') AS b, max(q_hat) FILTER (band = '50%') AS c FROM cqr_fit)"
    " WHERE split = 'holdout')) GROUP BY horizon_days", *SPLIT, "cqr_fit"))
def cqr_apply(spark, sf_dir):
    rows = split_frame(spark, sf_dir)
    fit = C.fit_cqr(spark, rows.where("split = 'calibration'"))
    held = C.apply_cqr(rows.where("split = 'holdout'"), fit)
    return held.groupBy("horizon_days").agg(
        F.count(F.lit(1)).alias("n_rows"), *[rnd(F.avg(c)).alias(f"mean_{c}") for c in QUANTILE_COLUMNS],
        *[rnd(M.coverage("target_revenue", quantile_column(lo), quantile_column(hi)), 6).alias(f"coverage_{label[:-1]}")
          for lo, hi, _, label in BANDS])


CROSSED = ["revenue_lag_7", "revenue_lag_14", "revenue_lag_28", "revenue_roll_mean_7", "revenue_roll_mean_28"]


@query("quantile_sort", with_ctes(
    "SELECT campaign_id, " + ", ".join(f"{sql_rnd(f'l[{i + 1}]', 6)} AS s{i}" for i in range(5))
    + f" FROM (SELECT campaign_id, list_sort([{', '.join(f'coalesce({c}, 0)' for c in CROSSED)}]) AS l FROM snapshot)",
    *SCORING[:-1]))
def quantile_sort(spark, sf_dir):
    s = X.latest_snapshot(features(spark, sf_dir), ad_canonical(spark, sf_dir))
    fixed = sort_row([F.coalesce(c, F.lit(0.0)) for c in CROSSED])
    return s.select("campaign_id", *[rnd(c, 6).alias(f"s{i}") for i, c in enumerate(fixed)])


@query("pinned_crossing", with_ctes(f"""
SELECT campaign_id, {sql_rounded(6, 'p0', 'p1', 'p2', 'p3', 'p4')} FROM (
  SELECT campaign_id, least(c0, c1, c2) AS p0, least(c1, c2) AS p1, c2 AS p2, greatest(c3, c2) AS p3, greatest(c4, c3, c2) AS p4
  FROM (SELECT campaign_id, {', '.join(f'greatest(coalesce({c}, 0) - 500, 0) AS c{i}' for i, c in enumerate(CROSSED))} FROM snapshot))""",
    *SCORING[:-1]))
def pinned_crossing(spark, sf_dir):
    s = X.latest_snapshot(features(spark, sf_dir), ad_canonical(spark, sf_dir))
    fixed = pin_median([F.coalesce(c, F.lit(0.0)) - 500 for c in CROSSED], 2)
    return s.select("campaign_id", *[rnd(c, 6).alias(f"p{i}") for i, c in enumerate(fixed)])


@query("cross_validation_report", with_ctes(f"""
, m AS (SELECT fold, {sql_rnd(WAPE_SQL.format(p='prediction'), 6)} AS wape, avg(CASE WHEN target_revenue BETWEEN q10 AND q90 THEN 1.0::DOUBLE ELSE 0 END) AS c80,
  avg(CASE WHEN target_revenue BETWEEN q05 AND q95 THEN 1.0::DOUBLE ELSE 0 END) AS c90 FROM fold_rows WHERE role = 'validation' GROUP BY fold)
SELECT count(*) AS n_folds, {sql_rnd('avg(wape)', 6)} AS wape, {sql_rnd('avg(c80)', 6)} AS coverage_80, {sql_rnd('avg(c90)', 6)} AS coverage_90 FROM m""".replace("\n, m AS", ", m AS", 1), *FOLDS))
def cross_validation_report(spark, sf_dir):
    held = S.walk_forward_roles(scored(spark, sf_dir)).where("role = 'validation'")
    y = "target_revenue"
    per_fold = held.groupBy("fold").agg(rnd(M.wape(y, "prediction"), 6).alias("wape"), M.coverage(y, "q10", "q90").alias("c80"),
                                        M.coverage(y, "q05", "q95").alias("c90"))
    return per_fold.agg(F.count(F.lit(1)).alias("n_folds"), rnd(F.avg("wape"), 6).alias("wape"),
                        rnd(F.avg("c80"), 6).alias("coverage_80"), rnd(F.avg("c90"), 6).alias("coverage_90"))


@query("out_of_fold", with_ctes(f"""
, v AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, origin_date, horizon_days ORDER BY fold) AS rn
        FROM fold_rows WHERE role = 'validation')
SELECT fold, horizon_days, count(*) AS n_rows, {sql_rnd(EXACT_REVENUE, 2)} AS revenue FROM v WHERE rn = 1 GROUP BY ALL""".replace("\n, v AS", ", v AS", 1), *FOLDS))
def out_of_fold(spark, sf_dir):
    held = S.walk_forward_roles(scored(spark, sf_dir)).where("role = 'validation'")
    return C.first_fold(held).groupBy("fold", "horizon_days").agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.expr(EXACT_REVENUE), 2).alias("revenue"))


CTES["drivers"] = """
SELECT f.*, month(date) AS month, weekofyear(date) AS week_of_year, isodow(date) - 1 AS day_of_week, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
       CAST(day(date) = 1 AS INTEGER) AS is_month_start, CAST(last_day(date) = date AS INTEGER) AS is_month_end, CAST(month(date) >= 10 AS INTEGER) AS is_q4,
       CAST((strftime(date, '%m%d') BETWEEN '0101' AND '0107') OR (strftime(date, '%m%d') BETWEEN '0210' AND '0214') OR (strftime(date, '%m%d') BETWEEN '0815' AND '0905')
         OR (strftime(date, '%m%d') BETWEEN '1120' AND '1202') OR (strftime(date, '%m%d') BETWEEN '1218' AND '1231') AS INTEGER) AS is_holiday_window,
       date_diff('day', date, make_date(CASE WHEN month(date) >= 7 THEN year(date) ELSE year(date) - 1 END, 12, 25)) AS days_to_dec25,
       w.revenue AS revenue_same_week_last_year
FROM frame f LEFT JOIN (SELECT campaign_id, isoyear(date) AS y, weekofyear(date) AS k, sum(revenue) AS revenue FROM daily GROUP BY ALL) w
  ON w.campaign_id = f.campaign_id AND w.y = isoyear(f.date) - 1 AND w.k = weekofyear(f.date)"""
SLOPES = ", ".join(f"regr_slope(target_revenue, {c}) AS b_{c}, avg({c}) AS m_{c}" for c in NUMERIC_FEATURES if c != "horizon_days")
ATTRIBUTED = [c for c in NUMERIC_FEATURES if c != "horizon_days"]


@query("attribution_topk", with_ctes(f"""
, s AS (SELECT horizon_days, {SLOPES} FROM drivers GROUP BY horizon_days),
a AS (SELECT horizon_days, channel, unnest([{', '.join(f"'{c}'" for c in ATTRIBUTED)}]) AS feature,
             unnest([{', '.join(f"coalesce(CASE WHEN isfinite(b_{c}) THEN b_{c} * ({c} - m_{c}) END, 0)" for c in ATTRIBUTED)}]) AS c FROM drivers JOIN s USING (horizon_days)),
g AS (SELECT horizon_days, channel, feature, avg(abs(c)) AS mean_abs, avg(c) AS mean_signed, count(*) AS n FROM a GROUP BY ALL
      UNION ALL SELECT horizon_days, 'total', feature, avg(abs(c)), avg(c), count(*) FROM a GROUP BY horizon_days, feature)
SELECT horizon_days, channel, feature, CAST(row_number() OVER (PARTITION BY horizon_days, channel ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank,
       {sql_rounded(4, 'mean_abs', 'mean_signed')}, n AS n_rows FROM g WHERE n >= 20 QUALIFY rank <= 10""".replace("\n, s AS", ", s AS", 1), *FRAME, "drivers"))
def attribution_topk(spark, sf_dir):
    """The ten strongest drivers of every horizon over all numeric features, for the total and each channel."""
    rows = X.forward_targets(features(spark, sf_dir)).select("horizon_days", "channel", "target_revenue", *[F.col(c).cast("double").alias(c) for c in ATTRIBUTED])
    rows = stored(rows, "drivers")
    # A dozen features at a time: wider aggregates are beyond the code generator, and each reads its own columns only.
    parts = []
    for at in range(0, len(ATTRIBUTED), 12):
        some = ATTRIBUTED[at:at + 12]
        part = rows.select("horizon_days", "channel", "target_revenue", *some)
        slopes = part.groupBy("horizon_days").agg(*[F.regr_slope("target_revenue", c).alias(f"b_{c}") for c in some])
        # One row per horizon.
        part = part.join(F.broadcast(slopes), "horizon_days")
        parts.append(C.linear_attributions(part, {c: [(F.col(f"b_{c}"), c)] for c in some}, by="channel", top=10, within=["horizon_days"]))
    order = W.partitionBy("horizon_days", "channel").orderBy(F.col("mean_abs").desc(), "feature")
    best = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return best.select("horizon_days", "channel", "feature", "rank", *rounded(4, "mean_abs", "mean_signed"), "n_rows")
