import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignflow.operators import allocation as A
from campaignflow.operators import backtest as T
from campaignflow.operators import bounds as B
from campaignflow.operators import curves as C
from campaignflow.operators import insights as I
from tests.helpers import DAY, START, group_days, pdf

CURVE = ("scenario string, channel string, campaign_type string, fit_ok boolean, L double, K double, n double, fallback_roas double, "
         "residual_std double, historical_spend double")


def allocate(spark, curves, total, floor=None, steps=50):
    df = spark.createDataFrame([("s", f"c{i}", "t", *c) for i, c in enumerate(curves)], CURVE)
    budget = spark.createDataFrame([("s", float(total), floor)], "scenario string, total_budget double, roas_floor double")
    return pdf(A.allocate(df, budget, steps=steps), "channel")


def hill(x, L, K, n):
    return L * x ** n / (K ** n + x ** n + 1e-9)


def test_flat_curves_give_the_better_roas_its_cap(spark):
    out = allocate(spark, [(False, None, None, None, 3.0, 0.0, 250.0), (False, None, None, None, 1.0, 0.0, 250.0)], 1000)
    assert out["allocation"].tolist() == [1000.0, 0.0]
    out = allocate(spark, [(False, None, None, None, 3.0, 0.0, 100.0), (False, None, None, None, 1.0, 0.0, 250.0)], 1000)
    assert out["allocation"].tolist() == [400.0, 600.0] and out["unallocated"].iloc[0] == pytest.approx(0)


def test_twin_sigmoids_concentrate(spark):
    twin = (True, 10000.0, 500.0, 3.0, 0.0, 10.0, 600.0)
    out = allocate(spark, [twin, twin], 600, steps=60)
    assert sorted(out["allocation"]) == [0.0, 600.0]
    assert out["predicted_revenue"].iloc[0] > 2 * hill(300, 10000, 500, 3)
    band = 0.6745 * np.sqrt(200)
    assert out["predicted_high"].iloc[0] - out["predicted_revenue"].iloc[0] == pytest.approx(band)


def test_allocation_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    steps = 20
    for _ in range(3):
        curves = [(True, float(rng.uniform(500, 3000)), float(rng.uniform(20, 200)), float(rng.uniform(0.5, 3)), 0.0, 1.0, float(rng.uniform(10, 60))) for _ in range(3)]
        out = allocate(spark, curves, 200, steps=steps)
        caps = [min(steps, int(c[6] * 4 / 10 + 1e-9)) for c in curves]
        reach = min(steps, sum(caps))
        best = max(sum(hill(k * 10.0, *c[1:4]) for k, c in zip(ks, curves))
                   for ks in itertools.product(*[range(c + 1) for c in caps]) if sum(ks) == reach)
        assert out["predicted_revenue"].iloc[0] == pytest.approx(best)
        assert out["allocation"].sum() == pytest.approx(reach * 10.0)
        assert sum(hill(a, *c[1:4]) for a, c in zip(out["allocation"], curves)) == pytest.approx(best)


def test_roas_floor_binds_and_relaxes(spark):
    curve = (True, 1000.0, 100.0, 1.0, 0.0, 1.0, 1000.0)
    free, bound = allocate(spark, [curve], 1000), allocate(spark, [curve], 1000, 5.0)
    assert not free["floor_binding"].iloc[0] and bound["floor_binding"].iloc[0]
    assert bound["blended_roas"].iloc[0] >= 5.0 > free["blended_roas"].iloc[0]
    assert bound["unallocated"].iloc[0] > 0


def test_curve_fit_recovers_a_saturating_group(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        x = rng.uniform(10, 1000)
        rows.append(("a", "curve", i, x, hill(x, 5000, 300, 1.5) * (1 + 0.02 * rng.normal())))
        rows.append(("a", "noise", i, x, rng.uniform(0, 1000)))
        if i < 5:
            rows.append(("a", "few", i, x, 2 * x))
    out = pdf(C.fit_hill_curves(group_days(spark, rows), half_life=None)).set_index("campaign_type")
    assert out.loc["curve", "fit_ok"] and out.loc["curve", "r_squared"] > 0.98
    for x in (50, 300, 900):
        got = hill(x, *out.loc["curve", ["L", "K", "n"]].astype(float))
        assert got == pytest.approx(hill(x, 5000, 300, 1.5), rel=0.03)
    assert not out.loc["noise", "fit_ok"] and out.loc["few", "note"] == "insufficient_data_for_fit_attempt"
    assert out.loc["few", "fallback_roas"] == pytest.approx(2.0)


def test_recency_weight_prefers_the_new_regime(spark):
    rows = [("a", "t", i, 100, 100 if i < 200 else 600) for i in range(290)]
    got = C.recency_roas(C.weighted_points(group_days(spark, rows))).first()["fallback_roas"]
    assert 4.0 < got < 6.0


def test_saturation_and_marginal(spark):
    df = spark.createDataFrame([(True, 100.0, 50.0, 1.0, 2.0, s) for s in (10.0, 50.0, 90.0)] + [(False, None, None, None, 2.0, 10.0)],
                               "fit_ok boolean, L double, K double, n double, fallback_roas double, s double")
    out = df.select(C.saturation_status("s").alias("st"), C.marginal("s").alias("m"), C.response("s").alias("r")).toPandas()
    assert out["st"].tolist() == ["room_to_grow", "approaching_saturation", "near_saturation", "unknown_insufficient_data"]
    assert out["m"].iloc[0] == pytest.approx((hill(10.001, 100, 50, 1) - hill(9.999, 100, 50, 1)) / 0.002, rel=1e-4)
    assert out["m"].iloc[3] == 2.0 and out["r"].iloc[3] == 20.0


def regime(spark):
    return group_days(spark, [r for i in range(290) for r in (
        ("a", "A", i, 100, 300), ("b", "B", i, 100, 100 if i < 200 else 600))])


def test_replanning_beats_a_frozen_plan_after_a_regime_shift(spark):
    days = regime(spark)
    out = pdf(T.policy_backtest(days, spark.createDataFrame([(200.0,)], "total_budget double")), "window")
    assert len(out) == 3 and out["n_days"].tolist() == [30] * 3
    assert out["frozen_daily_revenue"].iloc[0] == pytest.approx(out["replan_daily_revenue"].iloc[0])
    assert out["replan_daily_revenue"].iloc[2] > out["frozen_daily_revenue"].iloc[2]


def test_regret_against_plain_sums(spark):
    days = group_days(spark, [r for i in range(280) for r in (("a", "t", i, 400, 600), ("b", "t", i, 400, 1600))])
    bt = T.policy_backtest(days)
    actual = pdf(T.actual_windows(days, bt))
    assert actual["actual_daily_revenue"].tolist() == pytest.approx([2200.0] * 3)
    audit = T.regret_audit(days, bt).first()
    assert audit["actual_avg"] == pytest.approx(2200.0) and audit["replan_vs_actual"] > 0


def test_bounds_and_clamp(spark):
    rows = [("a", "t", i, 10, 10 * (1 + i / 100)) for i in range(101)] + [("a", "new", i, 10, 30) for i in range(3)]
    bounds = B.roas_bounds(group_days(spark, rows))
    got = pdf(bounds).set_index("campaign_type")
    assert got.loc["t", "lo"] == pytest.approx(1.05 / 1.5) and got.loc["t", "hi"] == pytest.approx(1.95 * 1.5)
    assert np.isnan(got.loc["new", "hi"]) and got.loc["new", "median"] == 3.0
    f = spark.createDataFrame([("a", "t", 1000.0, 100.0), ("a", "t", 200.0, 100.0), ("a", "new", 9e9, 1.0), ("z", "t", 5.0, 1.0), ("a", "t", 5.0, 0.0)],
                              "channel string, campaign_type string, rev double, spend double")
    out = B.clamp_to_bounds(f, bounds, "rev", "spend").toPandas().sort_values("rev").reset_index(drop=True)
    assert out["plausibility_flag"].tolist() == [False, False, False, True, False]
    hit = out[out["plausibility_flag"]].iloc[0]
    assert hit["rev"] == 1000.0 and hit["rev_display"] == pytest.approx(292.5) and "10.00x" in hit["plausibility_caveat"]


def test_anomaly_needs_variation_and_history(spark):
    rows = [("a", "t", i, 1, 100 + i % 3) for i in range(60)] + [("a", "t", 60, 1, 900), ("b", "t", 0, 1, 5), ("b", "t", 1, 1, 900)]
    out = I.anomalies(group_days(spark, rows)).collect()
    assert len(out) == 1 and out[0]["date"] == START + 60 * DAY and out[0]["z_score"] > 3


def test_period_over_period(spark):
    rows = [("a", "t", i, 10, 100 if i < 30 else 150) for i in range(60)] + [("n", "t", 59, 1, 1)]
    got = {r["channel"]: r for r in I.period_over_period(group_days(spark, rows), ["channel"]).collect()}
    assert got["a"]["revenue_delta_pct"] == 50.0 and got["a"]["spend_delta_pct"] == 0.0 and got["n"]["revenue_delta_pct"] is None


def test_weekday_spread_preserves_the_total(spark):
    rows = [("a", "t", i, 1, 100 + 50 * ((START + i * DAY).weekday() == 5)) for i in range(70)] + [("short", "t", i, 1, 1) for i in range(10)]
    profile = I.weekday_profile(group_days(spark, rows))
    assert {r["channel"] for r in profile.collect()} == {"a"}
    totals = spark.createDataFrame([("a", START + 70 * DAY, 30, 3000.0)], "channel string, forecast_as_of date, horizon_days int, total double")
    out = pdf(I.spread_by_weekday(totals, profile), "day")
    assert len(out) == 30 and out["day_value"].sum() == pytest.approx(3000.0)
    assert out.loc[out["weekday"] == 5, "day_value"].min() > out.loc[out["weekday"] != 5, "day_value"].max()


def test_leaders_and_laggards(spark):
    df = spark.createDataFrame([(f"c{i}", float(v)) for i, v in enumerate([0, 0, 5, 4, 3, 2, 1])], "campaign_id string, v double")
    out = pdf(I.leaders(df, "v", 2), "list", "v")
    assert out["campaign_id"].tolist() == ["c6", "c5", "c3", "c2"]
    none = spark.createDataFrame([("x", 0.0), ("y", 0.0)], "campaign_id string, v double")
    assert I.leaders(none, "v", 2).where("list = 'laggard'").count() == 2


def test_grounding_accepts_backed_numbers_only(spark):
    context = '{"revenue": 1000.0, "roas": 4.2, "date": "2024-11-27", "loss": -300}'
    texts = [(0, "Revenue 1,010 at 4.2x on 2024-11-27, minus -295."), (1, "Revenue 1,010 but also 5000 units."), (2, "No figures."), (3, "off by -320")]
    claims = spark.createDataFrame(texts, "id int, text string")
    ctx = spark.createDataFrame([(i, context) for i in range(4)], "id int, context string")
    got = {r["id"]: r for r in I.grounding_verdict(claims, ctx, "id").collect()}
    assert [got[i]["grounded"] for i in range(4)] == [True, False, True, False]
    assert got[1]["smallest_unsupported"] == 5000.0 and got[2]["n_claimed"] == 0


def test_grounding_sweep_equals_all_pairs(spark):
    rng = np.random.default_rng(11)
    allowed = [np.round(rng.normal(0, 100, 30), 2) for _ in range(10)]
    claimed = [np.round(rng.normal(0, 100, 40), 2) for _ in range(10)]
    text = spark.createDataFrame([(i, " ; ".join(map(str, c))) for i, c in enumerate(claimed)], "id int, text string")
    ctx = spark.createDataFrame([(i, " ; ".join(map(str, a))) for i, a in enumerate(allowed)], "id int, context string")
    got = {(r["id"], r["number"]) for r in I.unsupported_numbers(text, ctx, "id").collect()}
    want = {(i, float(n)) for i in range(10) for n in claimed[i] if not any(abs(n - a) <= max(0.02 * abs(a), 0.5) for a in allowed[i])}
    assert got == want


def test_recommendation_classes(spark):
    df = spark.createDataFrame([("room_to_grow", 3.0, 2.0), ("room_to_grow", 1.0, 2.0), ("near_saturation", 3.0, 2.0), ("approaching_saturation", 3.0, 2.0)],
                               "s string, r double, b double")
    assert [x[0] for x in df.select(I.channel_recommendation("s", "r", "b")).collect()] == ["scale", "stable", "diminishing", "approaching"]
    t = spark.createDataFrame([(5.0, -1.0), (30.0, 10.0), (5.0, 10.0), (-1.0, 3.0), (None, 1.0)], "r double, s double")
    assert [x[0] for x in t.select(I.trend_class("r", "s")).collect()] == ["efficiency_improving", "strong_growth", "growth_with_caution", "under_pressure", "unknown"]


def test_moves_keep_the_largest_changes(spark):
    out = spark.createDataFrame([("s", "c", f"t{i}", 10.0 * i, 0.5) for i in range(9)],
                                "scenario string, channel string, campaign_type string, allocation double, historical_spend double")
    got = pdf(A.budget_moves(out), "rank")
    assert got["campaign_type"].tolist() == ["t8", "t7", "t6", "t5", "t4", "t3"]
    assert F is not None
