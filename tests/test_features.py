import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campaignflow.functions.calendar import calendar_columns
from campaignflow.operators import daily as D
from campaignflow.operators import features as X
from campaignflow.operators import segments as S
from campaignflow.operators import splits as P
from tests.helpers import DAY, START, canonical, group_days, pdf, row


def test_constant_funnel(spark):
    last = pdf(X.daily_features(canonical(spark, [row(i) for i in range(40)])), "date").iloc[-1]
    want = {"ctr_roll_28": 0.05, "cvr_roll_28": 0.1, "cpm_roll_28": 100.0, "cpa_roll_28": 20.0, "frequency_roll_28": 2.5,
            "video_view_rate_roll_28": 0.2, "trailing_roas_28": 4.0, "revenue_roll_std_28": 0.0, "revenue_trend_14_28": 0.0,
            "campaign_age_days": 39, "was_observed_frac_30": 1.0}
    for name, value in want.items():
        assert last[name] == pytest.approx(value), name


def test_zero_denominators_are_null(spark):
    rows = [row(i, spend=0.0, clicks=0.0, impressions=0.0, conversions=0.0) for i in range(20)]
    out = pdf(X.daily_features(canonical(spark, rows)))
    for name in ("ctr_roll_28", "cvr_roll_28", "cpa_roll_28", "cpm_roll_28", "trailing_roas_7", "campaign_expanding_roas"):
        assert out[name].isna().all(), name


def test_gaps_are_filled_but_never_invented(spark):
    kept = [0, 1, 4, 9]
    rows = [row(i, reach=None, daily_budget=10.0 if i == 1 else None, day=START + i * DAY) for i in kept]
    dense = pdf(D.dense_calendar(D.campaign_day(canonical(spark, rows))), "date")
    assert len(dense) == 10 and dense["was_observed"].sum() == 4
    assert dense["reach"].isna().all()
    assert dense.loc[2, "spend"] == 0 and dense.loc[2, "video_views"] == 0
    assert np.isnan(dense.loc[0, "daily_budget"]) and (dense.loc[1:, "daily_budget"] == 10.0).all()
    assert (dense["campaign_name"] == "a::1").all()


def test_same_day_rows_are_summed(spark):
    rows = [row(0, reach=None, daily_budget=None), row(1, day=START, reach=None, daily_budget=7.0), row(2, day=START, reach=5.0, daily_budget=3.0)]
    one = D.campaign_day(canonical(spark, rows)).first()
    assert (one["spend"], one["reach"], one["daily_budget"]) == (300.0, 5.0, 7.0)


def test_day_sums_stand_for_the_rows(spark):
    """Days, group days and the last date come out the same from the kept sums, attributes and budgets in order of the rows."""
    rows = [row(i, day=START + i % 3 * DAY, channel="c" if i % 2 else None, daily_budget=None if i % 4 < 2 else float(i)) for i in range(24)]
    raw = canonical(spark, rows)
    sums = D.day_sums(raw)
    assert sums.count() == 6
    for fn, keys in ((D.campaign_day, ["campaign_id", "date"]), (lambda c: D.group_day(c, ("channel",)), ["date", "channel"]), (lambda c: c.agg(F.max("date").alias("date")), ["date"])):
        pd.testing.assert_frame_equal(pdf(fn(raw), *keys), pdf(fn(sums), *keys))


def test_year_over_year_uses_the_same_iso_week(spark):
    rows = [row(i, revenue=float(i)) for i in range(500)]
    out = pdf(X.daily_features(canonical(spark, rows)), "date")
    days = pd.to_datetime(out["date"])
    weeks = pd.Series(out["revenue"].to_numpy(), index=pd.MultiIndex.from_frame(days.dt.isocalendar()[["year", "week"]])).groupby(level=[0, 1]).sum()
    for i in (100, 380, 420, 499):
        iso = days[i].isocalendar()
        want = weeks.get((iso.year - 1, iso.week), np.nan)
        assert out.loc[i, "revenue_same_week_last_year"] == pytest.approx(want, nan_ok=True)


def test_forward_targets_against_plain_sums(spark):
    rows = [row(i, revenue=float(i), spend=1.0) for i in range(120)]
    out = pdf(X.training_frame(canonical(spark, rows), (30, 60), stride=7), "horizon_days", "origin_date")
    assert set(out["horizon_days"]) == {30, 60}
    for _, r in out.iterrows():
        i = (r["origin_date"] - START).days
        assert i >= 14 and (i - 14) % 7 == 0 and i + r["horizon_days"] < 120
        assert r["target_revenue"] == sum(range(i + 1, i + 1 + int(r["horizon_days"])))
        assert r["planned_future_daily_budget"] == pytest.approx(1.0)


def test_latest_snapshot_is_each_campaigns_own_last_day(spark):
    rows = [row(i) for i in range(20)] + [row(i, campaign="a::2") for i in range(30)]
    snap = pdf(X.latest_snapshot(X.daily_features(canonical(spark, rows))), "campaign_id")
    assert [(d - START).days for d in snap["origin_date"]] == [19, 29]
    assert set(snap["forecast_as_of"]) == {START + 29 * DAY}
    assert X.expand_horizons(spark.createDataFrame(snap[["campaign_id", "spend_roll_mean_28", "spend_lag_7"]])).count() == 6


def test_calendar_edges(spark):
    df = spark.createDataFrame([("2024-12-30",), ("2024-06-30",), ("2024-02-29",), ("2024-11-25",)], "s string").select(F.to_date("s").alias("date"))
    out = pdf(df.withColumns(calendar_columns("date")))
    assert out["is_holiday_window"].tolist() == [1, 0, 0, 1]
    assert out["days_to_dec25"].tolist() == [-5, -188, -66, 30]
    assert out["is_month_end"].tolist() == [0, 1, 1, 0]
    assert out["week_of_year"].tolist() == [1, 26, 9, 48]


def test_segment_found_and_weights_applied(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        broken = 200 <= i < 240
        zero = rng.random() < (0.95 if broken else 0.2)
        rows.append(("a", "x", i, 10, 0 if zero else 50))
        rows.append(("a", "y", i, 10, 50))
    found = S.anomalous_segments(group_days(spark, rows))
    got = pdf(found)
    assert len(got) == 1 and got.loc[0, "campaign_type"] == "x"
    assert 195 <= (got.loc[0, "start_date"] - START).days <= 225 and 0.1 <= got.loc[0, "suggested_weight"] <= 0.9
    frame = spark.createDataFrame([("a", t, START + i * DAY, 30) for t in "xy" for i in (100, 200)],
                                  "channel string, campaign_type string, origin_date date, horizon_days int")
    w = {(r["campaign_type"], (r["origin_date"] - START).days): r["anomaly_weight"] for r in S.overlap_weights(frame, found).collect()}
    assert w[("x", 200)] < 1 and w[("x", 100)] == w[("y", 200)] == 1


def frame(spark, n=400, campaigns=5):
    return spark.createDataFrame([(f"c{c}", START + i * DAY, h) for c in range(campaigns) for i in range(n) for h in (30, 60)],
                                 "campaign_id string, origin_date date, horizon_days int")


def test_chronological_split_never_leaks(spark):
    out = pdf(P.chronological_split(frame(spark)))
    last = {s: (g["origin_date"] + pd.to_timedelta(g["horizon_days"], unit="D")).max() for s, g in out.groupby("split")}
    first = {s: g["origin_date"].min() for s, g in out.groupby("split")}
    assert set(out["split"].dropna()) == {"train", "calibration", "holdout"}
    assert pd.Timestamp(last["train"]) <= pd.Timestamp(first["calibration"]) and pd.Timestamp(last["calibration"]) <= pd.Timestamp(first["holdout"])


def test_walk_forward_folds_expand(spark):
    out = P.walk_forward_roles(frame(spark)).groupBy("fold", "role").count().collect()
    n = {(r["fold"], r["role"]): r["count"] for r in out}
    assert [n[(f, "train")] for f in range(4)] == sorted(n[(f, "train")] for f in range(4))
    assert P.walk_forward_roles(frame(spark, 20, 1)).count() == 0


def test_campaign_folds_keep_campaigns_whole_and_balanced(spark):
    folds = pdf(P.campaign_folds(frame(spark, 3, 500)))
    assert folds["campaign_id"].is_unique and set(folds["fold"]) == set(range(5))
    assert folds.groupby("fold").size().max() - folds.groupby("fold").size().min() <= 1


def test_campaign_folds_balance_rows_of_unequal_campaigns(spark):
    rows = spark.range(1, 41).selectExpr("concat('c', id) AS campaign_id", "explode(sequence(1L, id * id)) AS n")
    folds = pdf(P.campaign_folds(rows, 4))
    per_fold = folds.groupby("fold")["n_rows"].sum()
    assert len(folds) == 40 and folds["n_rows"].sum() == rows.count()
    assert set(folds.groupby("fold").size()) == {10} and per_fold.max() - per_fold.min() <= 1600
    assert P.campaign_folds(rows.limit(0)).count() == 0


def test_even_subset_spans_the_range(spark):
    got = P.even_origin_subset(frame(spark, 100, 1), 5).select("origin_date").distinct().toPandas()["origin_date"]
    assert sorted((d - START).days for d in got) == [0, 25, 50, 74, 99]
