"""Tree totals, residual bands, reconciliation, coherence, calibration by level."""

from pyspark.sql import functions as F

from campaignflow.operators import hierarchy as H
from campaignflow.registry.base_sql import CTES, with_ctes
from campaignflow.registry.core import iso, query, rnd, rounded, sql_iso, sql_rnd, sql_rounded
from campaignflow.registry.forecast import SPLIT, split_frame
from campaignflow.registry.forecast import SCORING, live_scoring, pace_quantiles
from campaignflow.schema import BANDS, QUANTILE_COLUMNS, QUANTILES, quantile_column
from campaignflow.sources.fixtures import table

NODE = "concat_ws('/', 'total', channel, campaign_type, campaign_id)"
SETS = "GROUPING SETS (({b}), ({b}, channel), ({b}, channel, campaign_type), ({b}, channel, campaign_type, campaign_id))"
LEVEL = ("CASE WHEN campaign_id IS NOT NULL THEN 'campaign' WHEN campaign_type IS NOT NULL THEN 'campaign_type' "
         "WHEN channel IS NOT NULL THEN 'channel' ELSE 'total' END")

CTES["node_series"] = f"""
SELECT horizon_days, origin_date, {NODE} AS node_id, {LEVEL} AS level, sum(target_revenue) AS y, sum(prediction) AS model
FROM split WHERE split IN ('train', 'calibration') GROUP BY {SETS.format(b='horizon_days, origin_date')}"""
CTES["joint"] = """
SELECT horizon_days, origin_date FROM (
  SELECT horizon_days, origin_date, count(*) AS n FROM node_series WHERE level = 'channel' GROUP BY ALL)
JOIN (SELECT horizon_days, count(DISTINCT node_id) AS want FROM node_series WHERE level = 'channel' GROUP BY ALL) USING (horizon_days)
WHERE n = want"""
CTES["resid"] = """
SELECT s.*, CASE WHEN s.level IN ('total', 'channel') AND j.origin_date IS NULL THEN NULL ELSE s.y - s.model END AS r
FROM node_series s LEFT JOIN joint j ON j.horizon_days = s.horizon_days AND j.origin_date = s.origin_date"""
CTES["offsets"] = f"""
SELECT horizon_days, node_id, level, count(r) AS n_obs,
       CASE WHEN level IN ('total', 'channel') AND count(r) > 0 THEN 'joint_conformal'
            WHEN level NOT IN ('total', 'channel') AND count(r) >= 15 THEN 'marginal_conformal' ELSE 'rescaled_sum' END AS method,
       {", ".join(f"quantile_cont(r, {q}) - quantile_cont(r, 0.5) AS off_{c}" for q, c in zip(QUANTILES, QUANTILE_COLUMNS))}
FROM resid GROUP BY horizon_days, node_id, level"""
TREE = (*SPLIT, "node_series", "joint", "resid", "offsets")


def history(spark, sf_dir):
    return split_frame(spark, sf_dir).where(F.col("split").isin("train", "calibration"))


@query("hierarchy_rollup", with_ctes(f"""
SELECT horizon_days, {sql_iso('origin_date', 'origin_day')}, node_id, level, {sql_rounded(4, 'y', 'model')} FROM node_series""",
    *SPLIT, "node_series"))
def hierarchy_rollup(spark, sf_dir):
    s = H.node_series(history(spark, sf_dir))
    return s.select("horizon_days", iso("origin_date", "origin_day"), "node_id", "level", *rounded(4, "y", "model"))


@query("residual_bands", with_ctes(f"""
SELECT horizon_days, node_id, level, n_obs, method, {", ".join(
    f"{sql_rnd(f'CASE WHEN method <> {chr(39)}rescaled_sum{chr(39)} THEN off_{c} END')} AS off_{c}" for c in QUANTILE_COLUMNS)} FROM offsets""", *TREE))
def residual_bands(spark, sf_dir):
    o = H.residual_offsets(H.node_series(history(spark, sf_dir)))
    return o.select("horizon_days", "node_id", "level", "n_obs", "method", *rounded(4, *[f"off_{c}" for c in QUANTILE_COLUMNS]))


@query("joint_alignment", with_ctes(
    "SELECT horizon_days, count(*) AS n_dates FROM joint GROUP BY horizon_days", *SPLIT, "node_series", "joint"))
def joint_alignment(spark, sf_dir):
    a = H.aligned_dates(H.node_series(history(spark, sf_dir)))
    return a.where("aligned").groupBy("horizon_days").agg(F.count(F.lit(1)).alias("n_dates"))


PACE = [0.35, 0.5, 0.75, 1.0, 1.3, 1.8, 2.2]
CTES["live_nodes"] = f"""
SELECT k.horizon_days, {NODE} AS node_id, {LEVEL} AS level, coalesce(sum(assumed_spend_total), 0) AS spend,
       {", ".join(f"coalesce(sum(naive_revenue * {m}::DOUBLE), 0) AS {c}" for m, c in zip(PACE, QUANTILE_COLUMNS))}
FROM (SELECT DISTINCT horizon_days AS horizon_days, channel, campaign_type, campaign_id FROM split WHERE split IN ('train', 'calibration')) k
LEFT JOIN (SELECT horizon_days AS lh, campaign_id AS lc, naive_revenue, assumed_spend_total FROM scoring) s ON lc = campaign_id AND lh = k.horizon_days
GROUP BY {SETS.format(b='k.horizon_days')}"""


def banded_sql(source: str, extra: str = "") -> str:
    """Shift each node's median by its offsets and pin it, or sort the summed quantiles."""
    shift = {c: f"greatest(n.q50 + o.off_{c}, 0)" for c in QUANTILE_COLUMNS}
    lows, highs = QUANTILE_COLUMNS[:3], QUANTILE_COLUMNS[4:]
    pinned = {
        **{c: f"least({', '.join([shift[x] for x in lows[i:]] + [shift['q50']])})" for i, c in enumerate(lows)},
        "q50": shift["q50"],
        **{c: f"greatest({', '.join([shift['q50']] + [shift[x] for x in highs[:i + 1]])})" for i, c in enumerate(highs)},
    }
    sort = "list_sort([" + ", ".join(f"n.{c}" for c in QUANTILE_COLUMNS) + "])"
    cols = ", ".join(f"CASE WHEN o.method <> 'rescaled_sum' THEN {pinned[c]} ELSE {sort}[{i + 1}] END AS {c}"
                     for i, c in enumerate(QUANTILE_COLUMNS))
    return (f"SELECT n.horizon_days, {extra} n.node_id, n.level, coalesce(o.method, 'rescaled_sum') AS method, "
            f"n.q50 AS reconciled_median, {cols} FROM {source} n LEFT JOIN offsets o "
            "ON o.horizon_days = n.horizon_days AND o.node_id = n.node_id")


CTES["live_bands"] = "SELECT b.*, n2.spend FROM (" + banded_sql("live_nodes") + ") b JOIN live_nodes n2 ON n2.horizon_days = b.horizon_days AND n2.node_id = b.node_id"
LIVE = (*SCORING, "frame", "scored", "cuts", "split", "node_series", "joint", "resid", "offsets", "live_nodes", "live_bands")


def live_quantiles(spark, sf_dir):
    live = live_scoring(spark, sf_dir).withColumn("spend", F.col("assumed_spend_total"))
    return pace_quantiles(live)


def reconciled(spark, sf_dir):
    return H.reconcile(live_quantiles(spark, sf_dir), history(spark, sf_dir))


@query("reconciled_hierarchy", with_ctes(f"""
SELECT horizon_days, node_id, level, method, {sql_rounded(4, 'spend', 'reconciled_median', *QUANTILE_COLUMNS)},
       {sql_rnd('q10 / nullif(spend, 0)', 6)} AS roas_q10, {sql_rnd('q90 / nullif(spend, 0)', 6)} AS roas_q90 FROM live_bands""", *LIVE))
def reconciled_hierarchy(spark, sf_dir):
    r = reconciled(spark, sf_dir)
    return r.select("horizon_days", "node_id", "level", "method", *rounded(4, "spend", "reconciled_median", *QUANTILE_COLUMNS),
                    *rounded(6, "roas_q10", "roas_q90"))


@query("method_counts", with_ctes(
    "SELECT horizon_days, level, method, count(*) AS n_nodes FROM live_bands GROUP BY ALL", *LIVE))
def method_counts(spark, sf_dir):
    return reconciled(spark, sf_dir).groupBy("horizon_days", "level", "method").agg(F.count(F.lit(1)).alias("n_nodes"))


CTES["child_sums"] = """
SELECT horizon_days, regexp_replace(node_id, '/[^/]*$', '') AS node_id, sum(reconciled_median) AS child_sum FROM live_bands WHERE level <> 'total' GROUP BY ALL"""


@query("coherence_error", with_ctes("""
SELECT b.horizon_days, count(*) AS n_parents, max(abs(reconciled_median - child_sum)) < 1e-4 AS coherent
FROM live_bands b JOIN child_sums c ON c.horizon_days = b.horizon_days AND c.node_id = b.node_id GROUP BY ALL""", *LIVE, "child_sums"))
def coherence_error(spark, sf_dir):
    e = H.coherence_error(reconciled(spark, sf_dir))
    return e.select("horizon_days", "n_parents", (F.col("max_abs_error") < 1e-4).alias("coherent"))


@query("share_of_parent", with_ctes(f"""
SELECT n.horizon_days, n.node_id, n.level, {sql_rnd('n.q50 / nullif(p.q50, 0)', 6)} AS share
FROM live_nodes n LEFT JOIN live_nodes p ON p.horizon_days = n.horizon_days AND p.node_id = CASE WHEN n.level = 'total' THEN '' ELSE regexp_replace(n.node_id, '/[^/]*$', '') END""", *LIVE[:-1]))
def share_of_parent(spark, sf_dir):
    s = H.share_of_parent(reconciled(spark, sf_dir), "reconciled_median")
    return s.select("horizon_days", "node_id", "level", rnd("share", 6).alias("share"))


CTES["hold_nodes"] = f"""
SELECT k.horizon_days, k.origin_date, {NODE} AS node_id, {LEVEL} AS level, {", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in QUANTILE_COLUMNS)}
FROM (SELECT h.horizon_days, h.channel, h.campaign_type, h.campaign_id, d.origin_date
      FROM (SELECT DISTINCT horizon_days, channel, campaign_type, campaign_id FROM split WHERE split IN ('train', 'calibration')) h
      JOIN (SELECT DISTINCT horizon_days, origin_date FROM split WHERE split = 'holdout') d USING (horizon_days)) k
LEFT JOIN (SELECT horizon_days AS lh, campaign_id AS lc, origin_date AS lo, {", ".join(QUANTILE_COLUMNS)} FROM split WHERE split = 'holdout') s
  ON lc = k.campaign_id AND lh = k.horizon_days AND lo = k.origin_date
GROUP BY {SETS.format(b='k.horizon_days, k.origin_date')}"""
CTES["hold_actual"] = f"""
SELECT horizon_days, origin_date, {NODE} AS node_id, sum(target_revenue) AS y FROM split WHERE split = 'holdout'
GROUP BY {SETS.format(b='horizon_days, origin_date')}"""


@query("band_calibration_by_level", with_ctes(
    "SELECT level, count(*) AS n_observations, " + ", ".join(
        f"{sql_rnd(f'avg(CASE WHEN y BETWEEN {quantile_column(lo)} AND {quantile_column(hi)} THEN 1.0::DOUBLE ELSE 0 END)', 6)} AS coverage_{label[:-1]}"
        for lo, hi, _, label in BANDS)
    + " FROM (" + banded_sql("hold_nodes", "n.origin_date,") + ") b JOIN hold_actual a ON a.horizon_days = b.horizon_days "
    "AND a.origin_date = b.origin_date AND a.node_id = b.node_id GROUP BY level", *TREE, "hold_nodes", "hold_actual"))
def band_calibration_by_level(spark, sf_dir):
    held = split_frame(spark, sf_dir).where("split = 'holdout'")
    out = H.calibration_by_level(held, history(spark, sf_dir))
    return out.select("level", "n_observations", *rounded(6, *[f"coverage_{label[:-1]}" for _, _, _, label in BANDS]))


CTES["supply_base"] = """
SELECT r_name, n_name, s_name, sum(l_extendedprice) AS f, count(*) + 1.0::DOUBLE AS w
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY GROUPING SETS ((), (r_name), (r_name, n_name), (r_name, n_name, s_name))"""
CTES["supply"] = """
SELECT *, concat_ws('/', 'total', r_name, n_name, s_name) AS node_id,
  CASE WHEN s_name IS NOT NULL THEN 3 WHEN n_name IS NOT NULL THEN 2 WHEN r_name IS NOT NULL THEN 1 ELSE 0 END AS depth,
  f * CASE WHEN s_name IS NOT NULL THEN 1.0::DOUBLE WHEN n_name IS NOT NULL THEN 1.05::DOUBLE WHEN r_name IS NOT NULL THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END AS g
FROM supply_base"""
# Up pass per level, then down pass per level, exactly the two-sweep solution of the diagonal problem.
CTES["up2"] = """SELECT s.r_name, s.n_name, cm, cv, (cm / cv + g / w) / (1 / cv + 1 / w) AS m, 1 / (1 / cv + 1 / w) AS v FROM supply s JOIN
 (SELECT r_name, n_name, sum(g) AS cm, sum(w) AS cv FROM supply WHERE depth = 3 GROUP BY ALL) c ON c.r_name = s.r_name AND c.n_name = s.n_name WHERE depth = 2"""
CTES["up1"] = """SELECT s.r_name, cm, cv, (cm / cv + g / w) / (1 / cv + 1 / w) AS m, 1 / (1 / cv + 1 / w) AS v FROM supply s JOIN
 (SELECT r_name, sum(m) AS cm, sum(v) AS cv FROM up2 GROUP BY ALL) c ON c.r_name = s.r_name WHERE depth = 1"""
CTES["up0"] = """SELECT cm, cv, (cm / cv + g / w) / (1 / cv + 1 / w) AS m FROM supply s, (SELECT sum(m) AS cm, sum(v) AS cv FROM up1) c WHERE depth = 0"""
CTES["down1"] = "SELECT u.r_name, u.cm, u.cv, u.m + u.v * (t.m - t.cm) / t.cv AS x FROM up1 u, up0 t"
CTES["down2"] = "SELECT u.r_name, u.n_name, u.cm, u.cv, u.m + u.v * (t.x - t.cm) / t.cv AS x FROM up2 u JOIN down1 t ON t.r_name = u.r_name"
CTES["down3"] = "SELECT s.node_id, s.g + s.w * (t.x - t.cm) / t.cv AS x FROM supply s JOIN down2 t ON t.r_name = s.r_name AND t.n_name = s.n_name WHERE depth = 3"


@query("wls_reconcile", with_ctes(f"""
SELECT node_id, {sql_rnd('x', 2)} AS reconciled FROM (SELECT 'total' AS node_id, m AS x FROM up0
UNION ALL SELECT 'total/' || r_name, x FROM down1 UNION ALL SELECT 'total/' || r_name || '/' || n_name, x FROM down2
UNION ALL SELECT node_id, x FROM down3)""", "supply_base", "supply", "up2", "up1", "up0", "down1", "down2", "down3"))
def wls_reconcile(spark, sf_dir):
    keys = ["r_name", "n_name", "s_name"]
    levels = ["total", "region", "nation", "supplier"]
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    # Supplier totals first: the dimension joins then run on one row per supplier.
    per_supplier = lines.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("f"), F.count(F.lit(1)).alias("n"))
    leaves = (
        per_supplier.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    nodes = H.rollup_tree(leaves, [F.sum("f").alias("f"), (F.sum("n") + 1.0).alias("variance")], keys=keys, levels=levels)
    # Independent forecasts per level that do not add up: each level errs by its own factor.
    bias = F.when(F.col("level") == "total", 1.1).when(F.col("level") == "region", 0.9).when(F.col("level") == "nation", 1.05).otherwise(1.0)
    out = H.wls_reconcile(nodes.withColumn("forecast", F.col("f") * bias), keys=keys, levels=levels)
    return out.select("node_id", rnd("reconciled", 2).alias("reconciled"))


CTES["cov_z"] = """
SELECT s.horizon_days, s.origin_date, node_id, stddev_samp(y - model) OVER h AS s,
       coalesce((y - model - avg(y - model) OVER h) / nullif(stddev_samp(y - model) OVER h, 0), 0) AS z
FROM node_series s JOIN joint j ON j.horizon_days = s.horizon_days AND j.origin_date = s.origin_date WHERE level = 'channel'
WINDOW h AS (PARTITION BY s.horizon_days, node_id)"""
CTES["cov_p"] = """
SELECT a.horizon_days, a.node_id AS node_a, b.node_id AS node_b, count(*) AS n, any_value(a.s) * any_value(b.s) AS scale,
       sum(a.z * b.z) / (count(*) - 1) AS c, var_samp(a.z * b.z) AS v
FROM cov_z a JOIN cov_z b ON a.horizon_days = b.horizon_days AND a.origin_date = b.origin_date AND a.node_id <= b.node_id GROUP BY ALL"""
CTES["cov_s"] = """
SELECT horizon_days, least(1, greatest(0, coalesce(sum(v * n * n / pow(n - 1, 3)) FILTER (node_a < node_b) / nullif(sum(c * c) FILTER (node_a < node_b), 0), 1))) AS shrinkage
FROM cov_p GROUP BY ALL"""


@query("residual_covariance", with_ctes(f"""
SELECT p.horizon_days, node_a, node_b, n, {sql_rnd('shrinkage', 6)} AS shrinkage,
       {sql_rnd('CASE WHEN node_a = node_b THEN scale ELSE (1 - shrinkage) * c * scale END / 1e6', 4)} AS covariance_m
FROM cov_p p JOIN cov_s s ON s.horizon_days = p.horizon_days""", *SPLIT, "node_series", "joint", "cov_z", "cov_p", "cov_s"))
def residual_covariance(spark, sf_dir):
    c = H.residual_covariance(H.node_series(history(spark, sf_dir)))
    return c.select("horizon_days", "node_a", "node_b", "n", rnd("shrinkage", 6).alias("shrinkage"),
                    rnd(F.col("covariance") / 1e6, 4).alias("covariance_m"))
