"""The merge tree of the allocation against a plain fold over the groups, and how its work spreads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignflow.operators import allocation as A
from campaignflow.operators import backtest as T
from tests.helpers import group_days
from tests.test_budget_insights import CURVE, hill


def curves_of(spark, rows):
    """Rows of (scenario, group, L, K, n, historical spend)."""
    return spark.createDataFrame([(s, f"c{g:03}", "t", True, *map(float, c), 0.0, 2.0, float(h)) for s, g, c, h in rows], CURVE)


def plain_fold(curves, total, steps):
    """Most revenue for each number of units, the groups folded one after another."""
    step = total / steps
    best = np.array([0.0])
    for c, h in curves:
        cap = min(steps, int(4 * h / step + 1e-9))
        rev = np.array([hill(k * step, *c) for k in range(cap + 1)])
        size = min(steps, len(best) + cap - 1) + 1
        best = np.array([max(best[b - k] + rev[k] for k in range(max(0, b - len(best) + 1), min(cap, b) + 1)) for b in range(size)])
    return best


def random_groups(rng, n):
    return [((rng.uniform(500, 3000), rng.uniform(20, 200), rng.uniform(0.5, 3)), rng.uniform(1, 30)) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_equals_the_fold_over_all_groups(spark, n):
    rng = np.random.default_rng(n)
    groups, total, steps = random_groups(rng, n), 400.0, 40
    other = random_groups(rng, 5)
    frame = curves_of(spark, [("s", i, *g) for i, g in enumerate(groups)] + [(None, i, *g) for i, g in enumerate(other)])
    budgets = spark.createDataFrame([("s", total), (None, 100.0), ("without groups", 5.0), ("nothing to spend", 0.0)], "scenario string, total_budget double")
    got = A.allocate(frame, budgets, steps=steps).toPandas()
    for name, own, budget in (("s", groups, total), (None, other, 100.0)):
        rows = got[got["scenario"].isna() if name is None else got["scenario"] == name].sort_values("channel")
        want = plain_fold(own, budget, steps)
        assert len(rows) == len(own) and rows["predicted_revenue"].iloc[0] == pytest.approx(want[-1])
        assert rows["allocation"].sum() == pytest.approx((len(want) - 1) * budget / steps)
        assert sum(hill(a, *c) for a, (c, _) in zip(rows["allocation"], own)) == pytest.approx(want[-1])
        assert all(a <= 4 * h + 1e-6 for a, (_, h) in zip(rows["allocation"], own))
    assert set(got["scenario"].dropna()) == {"s"}


def test_floor_takes_the_largest_affordable_budget(spark):
    groups, steps = random_groups(np.random.default_rng(9), 12), 40
    want = plain_fold(groups, 400.0, steps)
    floor = float(np.median([want[b] / (b * 10.0) for b in range(1, len(want))]))
    budgets = spark.createDataFrame([("s", 400.0, floor)], "scenario string, total_budget double, roas_floor double")
    row = A.allocate(curves_of(spark, [("s", i, *g) for i, g in enumerate(groups)]), budgets, steps=steps).first()
    b = max(b for b in range(1, len(want)) if want[b] / (b * 10.0) >= floor)
    assert row["predicted_revenue"] == pytest.approx(want[b]) and row["unallocated"] == pytest.approx(400 - b * 10.0) and row["floor_binding"]


def test_numbers_have_no_gaps_and_rounds_halve(spark):
    rng = np.random.default_rng(1)
    frame = curves_of(spark, [("s", i, *g) for i, g in enumerate(random_groups(rng, 300))])
    nodes = A.numbered(frame, ["scenario"])
    assert sorted(r["node"] for r in nodes.collect()) == list(range(300))
    nodes = nodes.select("scenario", "node", F.array(F.lit(0.0), F.col("L")).alias("best"))
    spread, sizes = [], []
    for _ in range(9):
        nodes = A.merged(nodes, ["scenario"], 10).cache()
        sizes.append(nodes.count())
        spread.append(nodes.select(F.spark_partition_id().alias("p")).distinct().count())
        nodes = nodes.drop("right")
    assert sizes == [150, 75, 38, 19, 10, 5, 3, 2, 1]
    # One merge reads two nodes; a round of many merges runs in all tasks, however few the scenarios.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = A.merged(A.numbered(frame, ["scenario"]).select("scenario", "node", F.array(F.lit(0.0)).alias("best")), ["scenario"], 10)
    assert many.select(F.spark_partition_id().alias("p")).distinct().count() == tasks
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_backtest_plans_are_one_row_per_window_and_group(spark):
    days = group_days(spark, [r for i in range(290) for r in (("a", "A", i, 100, 300), ("b", "B", i, 100, 100 if i < 200 else 600))] + [("late", "L", i, 50, 80) for i in range(240, 290)])
    plans = T.policy_plans(days, spark.createDataFrame([(200.0,)], "total_budget double"))
    rows = {(r["window"], r["channel"]): r for r in plans.collect()}
    assert len(rows) == plans.count() == 7 and (0, "late") not in rows and rows[2, "late"]["frozen"] is None
    assert {r["frozen"] for (w, c), r in rows.items() if c == "a"} == {rows[0, "a"]["replan"]}
    summary = {r["window"]: r for r in T.policy_summary(plans).collect()}
    for w in range(3):
        own = [r for (x, _), r in rows.items() if x == w]
        assert summary[w]["replan_daily_spend"] == pytest.approx(sum(r["replan"] or 0 for r in own))
        assert summary[w]["frozen_daily_revenue"] == pytest.approx(sum(r["frozen_revenue"] for r in own))


def test_uplift(spark):
    frame = spark.createDataFrame([("s", "a", "t", 10.0, 5.0, 40.0, 120.0), ("s", "b", "t", 0.0, 5.0, 60.0, 120.0)],
                                  "scenario string, channel string, campaign_type string, allocation double, historical_spend double, current_revenue double, predicted_revenue double")
    row = A.uplift(frame, days=60).first()
    assert (row["daily_uplift"], row["period_uplift"], row["uplift_pct"], row["recommended_spend"]) == (20.0, 1200.0, 20.0, 10.0)
