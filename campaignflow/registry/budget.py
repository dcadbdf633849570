"""Spend response, allocation, backtest, regret and the budget sweep."""

from pyspark.sql import functions as F

from campaignflow.functions.isotonic import interpolate, isotonic
from campaignflow.operators import allocation as A
from campaignflow.operators import backtest as T
from campaignflow.operators import curves as C
from campaignflow.operators import features as X
from campaignflow.registry.base_sql import CTES, GROUP_DAY, with_ctes
from campaignflow.registry.core import compose, iso, query, rnd, rounded, shared, sql_iso, sql_rnd, sql_rounded
from campaignflow.registry.features import SCORING, SNAPSHOT
from campaignflow.registry.groups import group_days
from campaignflow.registry.forecast import live_scoring
from campaignflow.schema import HORIZONS
from campaignflow.sources.workdir import checkpointed

G = "channel, campaign_type"



def points_sql(source: str, keys: str = G, half_life: str = "45.0::DOUBLE") -> str:
    return f"""
SELECT {keys}, date, spend AS x, revenue AS y, coalesce(least(1.0::DOUBLE, greatest(1e-3::DOUBLE,
       pow(0.5::DOUBLE, date_diff('day', date, max(date) OVER (PARTITION BY {keys})) / {half_life}))), 1) AS w FROM {source} WHERE spend > 0"""


def best_sql(points: str, grid: str, keys: str) -> str:
    return f"""
SELECT {keys}, l_max, min(struct_pack(sse := a - 2 * l * b + l * l * c, n := n, kk := kk, l := l)) AS best
FROM (SELECT {keys}, l_max, kk, n, a, b, c, least(coalesce(b / nullif(c, 0), 0), l_max) AS l
  FROM (SELECT {keys}, l_max, kk, n, sum(w * y * y) AS a, sum(w * h * y) AS b, sum(w * h * h) AS c
    FROM (SELECT {keys}, x, y, w, l_max, kk, n, pow(x, n) / (pow(kk, n) + pow(x, n) + 1e-9::DOUBLE) AS h
          FROM {points} JOIN {grid} USING ({keys})) GROUP BY {keys}, l_max, kk, n))
GROUP BY {keys}, l_max"""


def curve_ctes(points: str, keys: str = G, prefix: str = "") -> dict[str, str]:
    """Definitions of the fitted curves of each key over the table ``points``; the last is ``<prefix>curves``."""
    p = prefix
    out = {f"{p}stats": f"""
SELECT {keys}, count(*) AS n_points, count(DISTINCT round_even(x, 0)) AS n_levels, sum(y) AS sum_y, max(y) AS max_y,
       max(x) AS max_x, sum(w) AS sw, sum(w * y) AS swy, sum(w * y * y) AS swyy, stddev_pop(y) AS std_y, sum(w * y) / sum(w * x) AS fallback_roas
FROM {points} GROUP BY ALL""", f"{p}grid1": f"""
SELECT {keys}, (max_y * 1.5 + 1.0) * 20 + 1 AS l_max, max_x * pow(2.0::DOUBLE, k) AS kk, n
FROM {p}stats, (SELECT unnest({C.K_STEPS}::DOUBLE[]) AS k), (SELECT unnest({C.N_STEPS}::DOUBLE[]) AS n)
WHERE n_points >= 8 AND n_levels >= 5 AND sum_y > 0""", f"{p}best1": best_sql(points, f"{p}grid1", keys)}
    for i, (octaves, shares) in enumerate(C.REFINE, 2):
        out[f"{p}grid{i}"] = f"""
SELECT DISTINCT {keys}, l_max, best.kk * pow(2.0::DOUBLE, k) AS kk, least(6.0::DOUBLE, greatest(0.3::DOUBLE, best.n * (1 + m))) AS n
FROM {p}best{i - 1}, (SELECT unnest({octaves}::DOUBLE[]) AS k), (SELECT unnest({shares}::DOUBLE[]) AS m)"""
        out[f"{p}best{i}"] = best_sql(points, f"{p}grid{i}", keys)
    out[f"{p}curves"] = f"""
SELECT {keys}, n_points, fallback_roas, r2, at_bound, coalesce(r2 >= 0.1 AND NOT at_bound, false) AS fit_ok, l, kk, n, coalesce(resid, std_y) AS residual_std
FROM (SELECT s.*, b.best.l AS l, b.best.kk AS kk, b.best.n AS n, 1 - b.best.sse / (swyy - swy * swy / sw) AS r2,
             b.best.n <= 0.3003 OR b.best.n >= 5.994 AS at_bound
      FROM {p}stats s LEFT JOIN {p}best4 b USING ({keys})) s
LEFT JOIN (SELECT {keys}, stddev_pop(y - best.l * pow(x, best.n) / (pow(best.kk, best.n) + pow(x, best.n) + 1e-9::DOUBLE)) AS resid
           FROM {points} JOIN {p}best4 USING ({keys}) GROUP BY {keys}) r USING ({keys})"""
    return out


CTES["points"] = points_sql("group_day")
CTES |= curve_ctes("points")
CURVES = ("points", "stats", "grid1", "best1", "grid2", "best2", "grid3", "best3", "grid4", "best4", "curves")


def respond(x: str) -> str:
    return (f"CASE WHEN fit_ok THEN l * pow({x}, n) / (pow(kk, n) + pow({x}, n) + 1e-9::DOUBLE) "
            f"ELSE {x} * coalesce(fallback_roas, 0) END")


def slope(x: str) -> str:
    x = f"greatest({x}, 1e-6::DOUBLE)"
    return (f"CASE WHEN fit_ok THEN l * n * pow(kk, n) * pow({x}, n - 1) / (pow(pow(kk, n) + pow({x}, n), 2) + 1e-9::DOUBLE) "
            f"ELSE coalesce(fallback_roas, 0) END")


@shared
def curves(spark, sf_dir):
    return C.fit_hill_curves(group_days(spark, sf_dir))


@query("recency_roas", with_ctes(
    f"SELECT channel, campaign_type, n_points, {sql_rnd('fallback_roas', 6)} AS fallback_roas FROM stats", *GROUP_DAY, "points", "stats"))
def recency_roas(spark, sf_dir):
    return C.recency_roas(C.weighted_points(group_days(spark, sf_dir))).select(
        "channel", "campaign_type", "n_points", rnd("fallback_roas", 6).alias("fallback_roas"))


@query("hill_fit", with_ctes(f"""
SELECT channel, campaign_type, n_points, fit_ok, at_bound AS n_at_bound, {sql_rnd('r2', 4)} AS r_squared, {sql_rnd('fallback_roas', 6)} AS fallback_roas,
       {sql_rnd('CASE WHEN fit_ok THEN l END', 2)} AS l, {sql_rnd('CASE WHEN fit_ok THEN kk END', 2)} AS k, {sql_rnd('CASE WHEN fit_ok THEN n END', 4)} AS n,
       {sql_rnd('residual_std', 2)} AS residual_std FROM curves""", *GROUP_DAY, *CURVES))
def hill_fit(spark, sf_dir):
    return curves(spark, sf_dir).select(
        "channel", "campaign_type", "n_points", "fit_ok", "n_at_bound", rnd("r_squared").alias("r_squared"),
        rnd("fallback_roas", 6).alias("fallback_roas"), rnd("L", 2).alias("l"), rnd("K", 2).alias("k"), rnd("n", 4).alias("n"),
        rnd("residual_std", 2).alias("residual_std"))


CTES["current"] = """
SELECT channel, campaign_type, sum(coalesce(spend_roll_mean_28, spend_lag_7, 0)) AS spend FROM snapshot GROUP BY ALL"""


def current_spend(spark, sf_dir):
    snap = live_scoring(spark, sf_dir).where("horizon_days = 30")
    return snap.groupBy(*C.GROUP).agg(F.sum(X.recent_pace()).alias("current_spend"))


@query("hill_response", with_ctes(f"""
, top AS (SELECT channel, campaign_type, max(spend) AS max_spend FROM group_day WHERE spend > 0 GROUP BY ALL),
b AS (SELECT c.*, greatest(t.max_spend * 1.15, coalesce(CASE WHEN fit_ok THEN kk END, 0) * 2.2, coalesce(u.spend, 0) * 1.15, 1) AS x_max FROM curves c JOIN top t USING ({G}) LEFT JOIN current u USING ({G})),
x AS (SELECT *, CAST(i AS INTEGER) AS idx, x_max * i / 199.0::DOUBLE AS s FROM b, range(200) r(i))
SELECT {G}, idx AS i, {sql_rnd('s')} AS spend, {sql_rnd(respond('s'), 2)} AS revenue FROM x""".replace("\n, top AS", ", top AS", 1),
    *SNAPSHOT, "group_day", *CURVES, "current"))
def hill_response(spark, sf_dir):
    g = group_days(spark, sf_dir)
    top = g.where("spend > 0").groupBy(*C.GROUP).agg(F.max("spend").alias("max_spend"))
    out = C.chart_points(C.fit_hill_curves(g), current_spend(spark, sf_dir), top)
    return out.select(*C.GROUP, "i", rnd("spend").alias("spend"), rnd("revenue", 2).alias("revenue"))


SAT_SQL = """CASE WHEN fit_ok IS NULL THEN 'unknown_no_curve' WHEN NOT fit_ok THEN 'unknown_insufficient_data'
 WHEN {s} / kk < 0.5 THEN 'room_to_grow' WHEN {s} / kk < 1.5 THEN 'approaching_saturation' ELSE 'near_saturation' END"""


@query("marginal_roas", with_ctes(
    f"SELECT {G}, {sql_rnd(slope('u.spend'), 6)} AS marginal_roas, {sql_rnd(respond('u.spend'), 2)} AS revenue, {sql_rnd('u.spend')} AS current_spend FROM curves JOIN current u USING ({G})",
    *SNAPSHOT, "group_day", *CURVES, "current"))
def marginal_roas(spark, sf_dir):
    joined = curves(spark, sf_dir).join(current_spend(spark, sf_dir), C.GROUP)
    return joined.select(*C.GROUP, rnd(C.marginal("current_spend"), 6).alias("marginal_roas"),
                         rnd(C.response("current_spend"), 2).alias("revenue"), rnd("current_spend").alias("current_spend"))


CTES["saturated"] = f"""
SELECT s.campaign_id, s.channel, s.campaign_type, s.horizon_days, s.naive_revenue, s.assumed_spend_total, s.planned_future_daily_budget,
       {SAT_SQL.format(s='s.planned_future_daily_budget')} AS saturation_status, c.kk, c.fit_ok
FROM scoring s LEFT JOIN curves c ON c.channel = s.channel AND c.campaign_type = s.campaign_type"""
SATURATED = (*SCORING, "group_day", *CURVES, "saturated")


def saturated(spark, sf_dir):
    live = live_scoring(spark, sf_dir).join(curves(spark, sf_dir).drop("n_points", "note"), C.GROUP, "left")
    return live.withColumn("saturation_status", C.saturation_status("planned_future_daily_budget"))


@query("saturation", with_ctes(
    f"SELECT campaign_id, horizon_days, saturation_status, {sql_rnd('planned_future_daily_budget / CASE WHEN fit_ok THEN kk END', 2)} AS spend_to_k FROM saturated", *SATURATED))
def saturation(spark, sf_dir):
    return saturated(spark, sf_dir).select("campaign_id", "horizon_days", "saturation_status",
                                           rnd(F.col("planned_future_daily_budget") / F.col("K"), 2).alias("spend_to_k"))


@query("hill_divergence", with_ctes(f"""
, d AS (SELECT c.*, u.spend AS s0, u.spend * 2 AS s1 FROM curves c JOIN current u USING ({G})),
r AS (SELECT {G}, fit_ok AND s0 > 0 AS checked, CASE WHEN fit_ok AND s0 > 0 AND ({respond('s0')}) > 1e-6 THEN ({respond('s1')}) / ({respond('s0')}) END AS ratio FROM d)
SELECT {G}, coalesce(checked, false) AS hill_checked, {sql_rnd('ratio', 6)} AS hill_ratio,
       coalesce(ratio > 1e-6 AND greatest(2.0::DOUBLE, ratio) / greatest(least(2.0::DOUBLE, ratio), 1e-6) >= 1.75, false) AS hill_divergence_flag FROM r""".replace("\n, d AS", ", d AS", 1),
    *SNAPSHOT, "group_day", *CURVES, "current"))
def hill_divergence(spark, sf_dir):
    joined = curves(spark, sf_dir).join(current_spend(spark, sf_dir), C.GROUP).withColumn("doubled", F.col("current_spend") * 2)
    checks = C.divergence("current_spend", "doubled", F.lit(2.0))
    return joined.select(*C.GROUP, "fit_ok", "L", "K", "n", "fallback_roas", "current_spend", "doubled").withColumns(checks).select(
        *C.GROUP, "hill_checked", rnd("hill_ratio", 6).alias("hill_ratio"), "hill_divergence_flag")


#: Groups folded one after another in the statements: the kinds of campaigns in these tables.
FOLDS = 6


def plan_ctes(priced: str, prefix: str = "", floor: float | None = None) -> dict[str, str]:
    """Definitions that fold the groups of every ``scenario`` of ``priced`` (scenario, g, step, cap, curve) and walk back: ``<prefix>taken``, ``<prefix>stop``."""
    p = prefix
    out = {f"{p}rev": f"""SELECT scenario, g, k, {respond('(k * step)')} AS r FROM {priced}, range(201) t(k) WHERE k <= cap
UNION ALL SELECT scenario, g, 0, 0 FROM (SELECT DISTINCT scenario FROM {priced}), range(1, {FOLDS + 1}) t(g) WHERE (scenario, g) NOT IN (SELECT (scenario, g) FROM {priced})""",
           f"{p}dp0": f"SELECT DISTINCT scenario, 0::BIGINT AS b, 0.0::DOUBLE AS v, 0::BIGINT AS k FROM {priced}"}
    for g in range(1, FOLDS + 1):
        out[f"{p}dp{g}"] = f"""
SELECT scenario, b, best.v AS v, best.k AS k FROM (SELECT scenario, d.b + r.k AS b, max(struct_pack(v := d.v + r.r, k := r.k)) AS best
FROM {p}dp{g - 1} d JOIN {p}rev r USING (scenario) WHERE r.g = {g} AND d.b + r.k <= 200 GROUP BY 1, 2)"""
    out[f"{p}stop"] = f"SELECT scenario, max(b) AS b FROM {p}dp{FOLDS} GROUP BY 1" if floor is None else (
        f"SELECT scenario, coalesce(max(b) FILTER (WHERE b > 0 AND v / (b * step) >= {floor}), 0) AS b FROM {p}dp{FOLDS} JOIN (SELECT scenario, max(step) AS step FROM {priced} GROUP BY 1) USING (scenario) GROUP BY 1")
    out[f"{p}at{FOLDS}"] = f"SELECT scenario, b, 0::BIGINT AS k, 0 AS g FROM {p}stop"
    for g in range(FOLDS, 0, -1):
        out[f"{p}at{g - 1}"] = f"SELECT scenario, a.b - d.k AS b, d.k AS k, {g} AS g FROM {p}at{g} a JOIN {p}dp{g} d USING (scenario, b)"
    out[f"{p}taken"] = " UNION ALL ".join(f"SELECT scenario, g, k FROM {p}at{i}" for i in range(FOLDS))
    return out


CTES["priced"] = f"""
SELECT 0 AS scenario, c.*, u.spend AS hist, t.total / 200 AS step, t.total, row_number() OVER (ORDER BY {G}) AS g,
       CAST(least(200, floor(CASE WHEN u.spend > 0 THEN u.spend * 4 ELSE t.total END / (t.total / 200) + 1e-9)) AS INTEGER) AS cap
FROM curves c JOIN current u USING ({G}), (SELECT sum(spend) AS total FROM current) t"""


def allocated_sql(body: str, floor: float | None = None) -> str:
    """``body`` over ``allocated``: the groups of the current plan with their allocation and the plan's revenue."""
    plan = {"priced": CTES["priced"], **plan_ctes("priced", floor=floor), "allocated": f"""
SELECT p.*, t.k * p.step AS allocation, (SELECT d.v FROM dp{FOLDS} d JOIN stop USING (scenario, b)) AS revenue, (SELECT b FROM stop) AS stopped,
       {respond('hist')} AS current_revenue FROM priced p JOIN taken t USING (scenario, g)"""}
    return compose({**CTES, **plan}, body, *SNAPSHOT, "group_day", *CURVES, "current", *plan)


def allocation_sql(floor: float | None) -> str:
    return allocated_sql(f"""
SELECT channel, campaign_type, {sql_rnd('allocation')} AS allocation, {sql_rnd(slope('allocation'), 6)} AS marginal_roas,
       {sql_rnd('hist')} AS historical_spend, {sql_rnd('revenue', 2)} AS predicted_revenue, {sql_rnd('total - stopped * step')} AS unallocated,
       {'false' if floor is None else f'stopped < (SELECT max(b) FROM dp{FOLDS})'} AS floor_binding,
       {sql_rnd('revenue + 0.6745 * (SELECT sqrt(sum(residual_std * residual_std)) FROM priced)', 2)} AS predicted_high
FROM allocated""", floor)


def allocation(spark, sf_dir, floor=None):
    current = current_spend(spark, sf_dir)
    priced = curves(spark, sf_dir).join(current, C.GROUP).withColumn("scenario", F.lit("now")).withColumn("historical_spend", F.col("current_spend"))
    budgets = current.agg(F.sum("current_spend").alias("total_budget")).withColumn("scenario", F.lit("now"))
    if floor is not None:
        budgets = budgets.withColumn("roas_floor", F.lit(floor))
    return A.allocate(priced, budgets)


def allocation_columns(out):
    return out.select("channel", "campaign_type", *rounded(4, "allocation", "historical_spend", "unallocated"),
                      rnd("marginal_roas", 6).alias("marginal_roas"), *rounded(2, "predicted_revenue", "predicted_high"), "floor_binding")


@query("allocate_budget", allocation_sql(None))
def allocate_budget(spark, sf_dir):
    return allocation_columns(allocation(spark, sf_dir))


@query("roas_floor", allocation_sql(16.0))
def roas_floor(spark, sf_dir):
    return allocation_columns(allocation(spark, sf_dir, 16.0))


@query("budget_moves", allocated_sql(f"""
SELECT * EXCLUDE (size) FROM (
  SELECT CAST(row_number() OVER (ORDER BY abs(allocation - hist) DESC, {G}) AS INTEGER) AS rank, {G}, {sql_rnd('allocation - hist', 2)} AS change, {sql_rnd('hist', 2)} AS current,
         {sql_rnd('allocation', 2)} AS recommended, {sql_rnd(slope('allocation'), 4)} AS marginal_roas,
         {sql_rnd('revenue - (SELECT sum(current_revenue) FROM allocated)', 2)} AS daily_uplift, abs(allocation - hist) AS size
  FROM allocated WHERE abs(allocation - hist) >= 1) WHERE rank <= 6"""))
def budget_moves(spark, sf_dir):
    plan = allocation(spark, sf_dir)
    moves = A.budget_moves(plan).join(A.uplift(plan).select("scenario", "daily_uplift"), "scenario")
    return moves.select(
        "rank", "channel", "campaign_type", rnd("change", 2).alias("change"), rnd("historical_spend", 2).alias("current"),
        rnd("allocation", 2).alias("recommended"), rnd("marginal_roas", 4).alias("marginal_roas"), rnd("daily_uplift", 2).alias("daily_uplift"))


@query("budget_uplift", allocated_sql(f"""
SELECT {sql_rnd('max(allocated.total)', 2)} AS budget, {sql_rnd('sum(hist)', 2)} AS current_spend, {sql_rnd('sum(allocation)', 2)} AS recommended_spend,
       {sql_rnd('sum(current_revenue)', 2)} AS current_revenue, {sql_rnd('max(revenue)', 2)} AS predicted_revenue, h AS horizon_days,
       {sql_rnd('max(revenue) - sum(current_revenue)', 2)} AS daily_uplift, {sql_rnd('(max(revenue) - sum(current_revenue)) * h', 2)} AS period_uplift,
       {sql_rnd('100 * (max(revenue) - sum(current_revenue)) / sum(current_revenue)')} AS uplift_pct
FROM allocated, (SELECT unnest([30, 60, 90]) AS h) GROUP BY h"""))
def budget_uplift(spark, sf_dir):
    """Current against recommended spend: uplift per day, per period of each horizon, and in per cent."""
    plan = checkpointed(allocation(spark, sf_dir))
    budget = plan.groupBy("scenario").agg(F.max("total_budget").alias("budget"))
    rows = budget.join(A.uplift(plan), "scenario").withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    return rows.withColumn("period_uplift", F.col("daily_uplift") * F.col("horizon_days")).select(
        "horizon_days", *rounded(2, "budget", "current_spend", "recommended_spend", "current_revenue", "predicted_revenue", "daily_uplift", "period_uplift"),
        rnd("uplift_pct").alias("uplift_pct"))


WR = f"\"window\", role, {G}"
BACKTEST = {
    "win": """SELECT CAST(i AS INTEGER) AS "window", max(date) - 90 + i::INTEGER * 30 AS s, max(date) - 60 + i::INTEGER * 30 AS e, max(date) - 105 + i::INTEGER * 30 AS f
FROM group_day, range(3) t(i) GROUP BY i""",
    "budget": """SELECT sum(spend) / 28 AS total FROM group_day, (SELECT max(date) AS last FROM group_day) WHERE date >= last - 28""",
    "used": f"""SELECT "window", 'decide' AS role, {G}, date, spend, revenue FROM group_day, win WHERE date < s
UNION ALL SELECT "window", 'score', {G}, date, spend, revenue FROM group_day, win WHERE date >= f AND date < e""",
    "bt_points": points_sql("used", WR, "CASE WHEN role = 'decide' THEN 45.0::DOUBLE END"),
    **curve_ctes("bt_points", WR, "bt_"),
    "bt_priced": f"""SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY {G}) AS g, total / 200 AS step,
  CAST(least(200, floor(CASE WHEN hist > 0 THEN hist * 4 ELSE total END / (total / 200) + 1e-9)) AS INTEGER) AS cap
FROM (SELECT c."window" AS scenario, c.*, h.spent / s.span AS hist, total FROM bt_curves c
  JOIN (SELECT {WR}, sum(spend) AS spent FROM used GROUP BY ALL) h USING ({WR})
  JOIN (SELECT "window", date_diff('day', min(date), max(date)) + 1 AS span FROM used WHERE role = 'decide' GROUP BY 1) s USING ("window"), budget WHERE role = 'decide')""",
    **plan_ctes("bt_priced", "bt_"),
    "planned": f"""SELECT p."window", {G}, t.k * p.step AS spend FROM bt_priced p JOIN bt_taken t USING (scenario, g)""",
    "plans": f"""SELECT "window", {G}, frozen, replan, coalesce(fresh_fit, false) AS fresh_fit,
  coalesce(CASE WHEN c.fit_ok IS NOT NULL THEN {respond('frozen')} END, 0) AS frozen_revenue, coalesce(CASE WHEN c.fit_ok IS NOT NULL THEN {respond('replan')} END, 0) AS replan_revenue
FROM (SELECT w."window", {G}, spend AS frozen FROM planned, (SELECT "window" FROM win) w WHERE planned."window" = 0) FULL JOIN (SELECT "window", {G}, spend AS replan FROM planned) USING ("window", {G})
  FULL JOIN (SELECT "window", {G}, fit_ok AS fresh_fit FROM bt_curves WHERE role = 'decide') USING ("window", {G})
  LEFT JOIN (SELECT * FROM bt_curves WHERE role = 'score') c USING ("window", {G})""",
    "policy": """SELECT "window", s, e, date_diff('day', s, e) AS n_days, count(*) FILTER (fresh_fit) AS n_fresh_fits, sum(frozen_revenue) AS frozen_daily_revenue,
  sum(replan_revenue) AS replan_daily_revenue, coalesce(sum(frozen), 0) AS frozen_daily_spend, coalesce(sum(replan), 0) AS replan_daily_spend FROM plans JOIN win USING ("window") GROUP BY 1, 2, 3""",
}


def backtest_sql(body: str) -> str:
    return compose({**CTES, **BACKTEST}, body, *GROUP_DAY, *BACKTEST)


@shared
def policy_plans(spark, sf_dir):
    return T.policy_plans(group_days(spark, sf_dir))


@query("policy_backtest", backtest_sql(f"""
SELECT "window", {sql_iso('s', 'window_start')}, {sql_iso('e', 'window_end')}, CAST(n_days AS INTEGER) AS n_days, n_fresh_fits,
       {sql_rounded(2, 'frozen_daily_revenue', 'replan_daily_revenue', 'frozen_daily_spend', 'replan_daily_spend')} FROM policy"""))
def policy_backtest(spark, sf_dir):
    out = T.policy_summary(policy_plans(spark, sf_dir))
    return out.select("window", iso("window_start", "window_start"), iso("window_end", "window_end"), "n_days", "n_fresh_fits",
                      *rounded(2, "frozen_daily_revenue", "replan_daily_revenue", "frozen_daily_spend", "replan_daily_spend"))


@query("backtest_allocations", backtest_sql(f"""
SELECT "window", {G}, {sql_rounded(2, 'frozen', 'replan', 'frozen_revenue', 'replan_revenue')}, fresh_fit FROM plans"""))
def backtest_allocations(spark, sf_dir):
    """Both plans of every window, one row per group."""
    return policy_plans(spark, sf_dir).select("window", *C.GROUP, *rounded(2, "frozen", "replan", "frozen_revenue", "replan_revenue"), "fresh_fit")


@query("regret_audit", backtest_sql(f"""
SELECT sum(n_days)::BIGINT AS n_days, {sql_rnd('sum(a * n_days) / sum(n_days)', 2)} AS actual_avg, {sql_rnd('sum(frozen_daily_revenue * n_days) / sum(n_days)', 2)} AS frozen_avg,
       {sql_rnd('sum(replan_daily_revenue * n_days) / sum(n_days)', 2)} AS replan_avg,
       {sql_rnd('sum(frozen_daily_revenue * n_days) / sum(a * n_days) - 1', 6)} AS frozen_vs_actual, {sql_rnd('sum(replan_daily_revenue * n_days) / sum(a * n_days) - 1', 6)} AS replan_vs_actual,
       {sql_rnd('sum(replan_daily_revenue * n_days) / sum(frozen_daily_revenue * n_days) - 1', 6)} AS replan_vs_frozen
FROM policy JOIN (SELECT "window", sum(revenue) / 30 AS a FROM group_day JOIN win ON date >= s AND date < e GROUP BY 1) USING ("window")"""))
def regret_audit(spark, sf_dir):
    out = T.regret_audit(group_days(spark, sf_dir), T.policy_summary(policy_plans(spark, sf_dir)))
    return out.select("n_days", *rounded(2, "actual_avg", "frozen_avg", "replan_avg"),
                      *rounded(6, "frozen_vs_actual", "replan_vs_actual", "replan_vs_frozen"))


@query("actual_windows", with_ctes(f"""
, w AS (SELECT i AS window, max(date) - 90 + i::INTEGER * 30 AS s, max(date) - 60 + i::INTEGER * 30 AS e FROM group_day, range(3) t(i) GROUP BY i)
SELECT CAST("window" AS INTEGER) AS "window", {sql_iso('s', 'window_start')}, {sql_rnd('sum(revenue) / 30')} AS actual_daily_revenue, {sql_rnd('sum(spend) / 30')} AS actual_daily_spend
FROM group_day JOIN w ON date >= s AND date < e GROUP BY ALL""".replace("\n, w AS", ", w AS", 1), *GROUP_DAY))
def actual_windows(spark, sf_dir):
    g = group_days(spark, sf_dir)
    out = T.actual_windows(g, T.replan_windows(g))
    return out.select("window", iso("window_start", "window_start"), *rounded(4, "actual_daily_revenue", "actual_daily_spend"))


# Budget multipliers of the sweep: 0.25 to 2.5 in steps of 0.15 (a fixed grid of 16 values).
MULTIPLIERS = [round(0.25 + 0.15 * i, 2) for i in range(16)]
CTES["sweep"] = f"""
SELECT s.channel, s.horizon_days, m AS multiplier, sum(m * planned_future_daily_budget) AS daily_spend,
       sum({respond('(m * planned_future_daily_budget)')}) * s.horizon_days AS raw
FROM scoring s JOIN curves c ON c.channel = s.channel AND c.campaign_type = s.campaign_type, (SELECT unnest({MULTIPLIERS}::DOUBLE[]) AS m)
GROUP BY s.channel, s.horizon_days, m"""


def sweep(spark, sf_dir):
    """Curve response of every campaign at each multiplier of its recent pace, summed by channel."""
    live = live_scoring(spark, sf_dir).join(curves(spark, sf_dir).drop("n_points", "note"), C.GROUP)
    grid = live.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in MULTIPLIERS])))
    spend = F.col("multiplier") * F.col("planned_future_daily_budget")
    return grid.groupBy("channel", "horizon_days", "multiplier").agg(
        F.sum(spend).alias("daily_spend"), (F.sum(C.response(spend)) * F.first("horizon_days")).alias("raw"))


@query("curve_sweep", with_ctes(
    f"SELECT channel, horizon_days, multiplier, {sql_rounded(2, 'daily_spend', 'raw')} FROM sweep", *SCORING, "group_day", *CURVES, "sweep"))
def curve_sweep(spark, sf_dir):
    return sweep(spark, sf_dir).select("channel", "horizon_days", "multiplier", *rounded(2, "daily_spend", "raw"))


# The wobble makes the swept totals non-monotone, so that the isotonic fit has violations to repair.
WOBBLE = [1.0, 1.3, 0.8, 1.1]
CTES["wobbled"] = f"""
SELECT channel, horizon_days, multiplier, raw * [{', '.join(f'{w}::DOUBLE' for w in WOBBLE)}][(row_number() OVER (PARTITION BY channel, horizon_days ORDER BY multiplier) - 1) % 4 + 1] AS y,
       row_number() OVER (PARTITION BY channel, horizon_days ORDER BY multiplier) AS i FROM sweep"""
CTES["isotone"] = """
SELECT k.channel, k.horizon_days, k.multiplier, k.i, (SELECT max(lo) FROM (
   SELECT a.i, min((SELECT avg(m.y) FROM wobbled m WHERE m.channel = k.channel AND m.horizon_days = k.horizon_days AND m.i BETWEEN a.i AND z.i)) AS lo
   FROM wobbled a, wobbled z WHERE a.channel = k.channel AND a.horizon_days = k.horizon_days AND z.channel = k.channel AND z.horizon_days = k.horizon_days
     AND a.i <= k.i AND z.i >= k.i GROUP BY a.i)) AS fitted FROM wobbled k"""


@query("isotonic_grid", with_ctes(
    f"SELECT channel, horizon_days, multiplier, {sql_rnd('fitted', 2)} AS fitted FROM isotone", *SCORING, "group_day", *CURVES, "sweep", "wobbled", "isotone"))
def isotonic_grid(spark, sf_dir):
    fitted = fitted_grid(spark, sf_dir)
    return fitted.select("channel", "horizon_days", F.explode(F.arrays_zip("xs", "fit")).alias("p")).select(
        "channel", "horizon_days", F.col("p.xs").alias("multiplier"), rnd("p.fit", 2).alias("fitted"))


def fitted_grid(spark, sf_dir):
    rows = sweep(spark, sf_dir).groupBy("channel", "horizon_days").agg(
        F.array_sort(F.collect_list(F.struct("multiplier", "raw"))).alias("pts"))
    wob = F.array(*[F.lit(w) for w in WOBBLE])
    rows = rows.withColumns({"xs": F.transform("pts", lambda p: p["multiplier"]),
                             "ys": F.transform("pts", lambda p, i: p["raw"] * wob[i % 4])})
    return rows.withColumn("fit", isotonic("ys"))


@query("interpolated_budget", with_ctes(f"""
, p AS (SELECT channel, horizon_days, multiplier AS x0, fitted AS y0, lead(multiplier) OVER w AS x1, lead(fitted) OVER w AS y1 FROM isotone WINDOW w AS (PARTITION BY channel, horizon_days ORDER BY multiplier))
SELECT channel, horizon_days, {sql_rnd('y0 + (y1 - y0) * (1.0::DOUBLE - x0) / (x1 - x0)', 2)} AS at_pace FROM p WHERE x0 <= 1.0 AND x1 > 1.0""".replace("\n, p AS", ", p AS", 1),
    *SCORING, "group_day", *CURVES, "sweep", "wobbled", "isotone"))
def interpolated_budget(spark, sf_dir):
    return fitted_grid(spark, sf_dir).select("channel", "horizon_days", rnd(interpolate(F.lit(1.0), "xs", "fit"), 2).alias("at_pace"))
