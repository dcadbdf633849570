import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignflow.functions import metrics as M
from campaignflow.functions.isotonic import interpolate, isotonic
from campaignflow.functions.quantiles import exact_quantiles, pin_median, sort_row
from campaignflow.operators import calibration as C
from campaignflow.operators import conformal as N
from campaignflow.operators import hierarchy as H
from campaignflow.schema import QUANTILE_COLUMNS, QUANTILES
from campaignflow.streaming import conformal_stream as S
from tests.helpers import DAY, START, pdf


def pairs(spark, y, p):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    y, p = rng.gamma(2, 50, 200) * (rng.random(200) > 0.3), rng.gamma(2, 50, 200)
    got = pairs(spark, y, p).agg(
        M.pinball("y", "p", 0.9).alias("pin"), M.wape("y", "p").alias("wape"), M.smape("y", "p").alias("smape"),
        M.tweedie_deviance("y", "p", 1.5).alias("dev"), M.coverage("y", F.lit(10.0), F.lit(120.0)).alias("cov")).first()
    d = y - p
    assert got["pin"] == pytest.approx(np.maximum(0.9 * d, -0.1 * d).mean())
    assert got["wape"] == pytest.approx(np.abs(d).sum() / y.sum())
    assert got["smape"] == pytest.approx((2 * np.abs(d) / (y + p)).mean())
    assert got["dev"] == pytest.approx(2 * (y ** 0.5 / (-0.5 * 0.5) - y * p ** -0.5 / -0.5 + p ** 0.5 / 0.5).mean())
    assert got["cov"] == pytest.approx(((y >= 10) & (y <= 120)).mean())
    assert pairs(spark, [0, 0], [1, 2]).agg(M.wape("y", "p").alias("w")).first()["w"] is None


def test_auc_with_ties(spark):
    y, s = [1, 0, 1, 0, 1, 0], [0.9, 0.9, 0.8, 0.3, 0.3, 0.1]
    wins = np.mean([(a > b) + 0.5 * (a == b) for a, l in zip(s, y) if l for b, m in zip(s, y) if not m])
    assert M.auc(pairs(spark, y, s), "y", "p") == pytest.approx(wins)


@pytest.mark.parametrize("limit", [5, 10_000])
def test_exact_quantiles_survive_ties_and_narrowing(spark, limit):
    rng = np.random.default_rng(3)
    a = rng.normal(size=3000)
    b = np.where(rng.random(3000) < 0.6, 7.0, rng.normal(size=3000))
    df = spark.createDataFrame([(float(x), float(z)) for x, z in zip(a, b)], "a double, b double")
    asks = {"a1": ("a", 0.05), "a2": ("a", 0.913), "b1": ("b", 0.5), "b2": ("b", 0.99), "b3": ("b", 1.0)}
    got = exact_quantiles(df, asks, limit=limit)
    for name, (c, level) in asks.items():
        assert got[name][2] == pytest.approx(np.quantile({"a": a, "b": b}[c], level), abs=1e-12), name


def test_crossing_repairs(spark):
    df = spark.createDataFrame([(5.0, -1.0, 3.0, 2.0, 9.0)], "a double, b double, c double, d double, e double")
    cols = list("abcde")
    assert [df.select(c.alias("x")).first()["x"] for c in sort_row(cols)] == [-1, 2, 3, 5, 9]
    assert [df.select(c.alias("x")).first()["x"] for c in pin_median(cols, 2)] == [0, 0, 3, 3, 9]


def test_isotonic_and_interpolation(spark):
    rng = np.random.default_rng(5)
    for _ in range(5):
        y = rng.normal(size=12)
        blocks = []
        for v in y:
            blocks.append([v, 1])
            while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
                (m2, n2), (m1, n1) = blocks.pop(), blocks.pop()
                blocks.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2])
        want = [m for m, n in blocks for _ in range(n)]
        df = spark.createDataFrame([([float(v) for v in y],)], "y array<double>")
        assert df.select(isotonic("y").alias("f")).first()["f"] == pytest.approx(want)
    grid = spark.createDataFrame([([1.0, 2.0, 4.0], [10.0, 20.0, 0.0])], "x array<double>, y array<double>")
    got = [grid.select(interpolate(F.lit(at), "x", "y").alias("v")).first()["v"] for at in (0.0, 1.0, 1.5, 3.0, 4.0, 9.0)]
    assert got == pytest.approx(list(np.interp([0, 1, 1.5, 3, 4, 9], [1, 2, 4], [10, 20, 0])))


def quantile_rows(spark, n=600, seed=0, sd=1.0):
    rng = np.random.default_rng(seed)
    z = {0.05: -1.645, 0.10: -1.282, 0.25: -0.674, 0.50: 0.0, 0.75: 0.674, 0.90: 1.282, 0.95: 1.645}
    rows = [tuple(100 + 10 * z[q] * 0.5 for q in QUANTILES) + (100 + 10 * sd * v,) for v in rng.normal(size=n)]
    return spark.createDataFrame([tuple(float(x) for x in r) for r in rows], ", ".join(f"{c} double" for c in QUANTILE_COLUMNS) + ", target_revenue double")


def test_cqr_restores_coverage(spark):
    fit = C.fit_cqr(spark, quantile_rows(spark, 2000, 1))
    out = C.apply_cqr(quantile_rows(spark, 2000, 2), fit)
    got = {r["band"]: r["empirical"] for r in C.reliability_table(out, []).collect()}
    assert got["90%"] == pytest.approx(0.9, abs=0.03) and got["80%"] == pytest.approx(0.8, abs=0.03) and got["50%"] == pytest.approx(0.5, abs=0.04)


def test_candidates_and_attributions(spark):
    rng = np.random.default_rng(2)
    rows = [("A" if i % 2 else "B", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "channel string, x_a double, x_b double")
    df = df.withColumns({"x_a": F.when(F.col("channel") == "A", F.col("x_a") * 5).otherwise(F.col("x_a") * 0.1),
                         "x_b": F.when(F.col("channel") == "B", F.col("x_b") * 5).otherwise(F.col("x_b") * 0.1)})
    one = spark.createDataFrame([(1.0, 1.0)], "b_x_a double, b_x_b double")
    top = {r["channel"]: r["feature"] for r in C.linear_attributions(df, one, ["x_a", "x_b"], "channel", 1).collect()}
    assert top["A"] == "x_a" and top["B"] == "x_b"
    c = C.compare_candidates(spark.createDataFrame([(10.0, 8.0, 12.0)], "target_revenue double, lo double, hi double"), {"lo": "lo", "hi": "hi"}, "lo").first()
    assert c["winner"] == "blend" and c["improvement"] == pytest.approx(1.0)


def series(n=600, shift=1.0, seed=0, low=-1.2816, high=1.2816):
    y = np.random.default_rng(seed).normal(size=n)
    y[n // 2:] *= shift
    return [(low, high, float(v)) for v in y]


@pytest.mark.parametrize("method", N.METHODS)
@pytest.mark.parametrize("shift", [1.0, 3.0])
def test_online_coverage(method, shift):
    c = N.Controller(method, alpha=0.2, min_history=60)
    hits = [c.step(*s)[4] for s in series(shift=shift)][60:]
    assert np.mean(hits) == pytest.approx(0.8, abs=0.07)


def test_plain_pid_equals_adaptive():
    a, b, c = (N.Controller(m, ki=0.0, kd=0.0) for m in N.METHODS)
    for s in series():
        one, two, three = a.step(*s), b.step(*s), c.step(*s)
        assert one == pytest.approx(two) and two == pytest.approx(three)


def test_score_window_and_state_round_trip():
    a = N.Controller("pid_learned", window=50)
    data = series(300)
    for i, s in enumerate(data):
        if i == 150:
            a = N.Controller("pid_learned", window=50).load(a.dump())
        got = a.step(*s)
        if i >= 20:
            assert len(a.ranked) <= 50 and sorted(a.scores[-50:]) == pytest.approx(a.ranked)
    b = N.Controller("pid_learned", window=50)
    assert got == pytest.approx([b.step(*s) for s in data][-1])


def test_stream_equals_batch(spark):
    rows = [(f"s{k}", i * 86400, *v) for k in range(2) for i, v in enumerate(series(60, seed=k))]
    df = spark.createDataFrame(rows, "series string, seq bigint, low double, high double, y double")
    batch = pdf(N.run_online(df, ["pid"]), "series", "seq")
    stream = pdf(S.replay(df, "pid", days_per_trigger=20), "series", "seq")
    assert stream["correction"].to_numpy() == pytest.approx(batch["correction"].to_numpy())
    assert stream["covered"].tolist() == batch["covered"].tolist() and stream["n_late"].max() == 0


def test_method_comparison(spark):
    rows = [("s", i, *v) for i, v in enumerate(series(400, 3.0))] + [("short", i, 0.0, 1.0, 0.5) for i in range(25)]
    out = pdf(N.compare_methods(spark.createDataFrame(rows, "series string, seq bigint, low double, high double, y double"), alpha=0.2))
    assert set(out["series"]) == {"s"} and set(out["method"]) == {"static", *N.METHODS}
    got = out.set_index("method")["coverage"]
    assert abs(got["adaptive"] - 0.8) < abs(got["static"] - 0.8)


# ---------------------------------------------------------------- hierarchy

def tree_rows(n_days, seed, sd=0.15):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n_days):
        for ch, mu in (("a", 1000.0), ("b", 2000.0)):
            for k in range(2):
                y = mu / 2 * (1 + sd * rng.normal())
                out.append((30, START + i * DAY, ch, "t", f"{ch}{k}", float(y), mu / 2))
    return out


SCHEMA = "horizon_days int, origin_date date, channel string, campaign_type string, campaign_id string, target_revenue double, prediction double"


def live(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.col("prediction") * m for c, m in zip(QUANTILE_COLUMNS, (.7, .8, .9, 1, 1.1, 1.2, 1.3))}).withColumn("spend", F.lit(10.0))


def test_reconciled_tree_is_coherent_and_ordered(spark):
    history = spark.createDataFrame(tree_rows(40, 0), SCHEMA)
    now = live(spark, tree_rows(1, 1)).where("campaign_id <> 'b1'").drop("origin_date")
    out = H.reconcile(now, history)
    got = pdf(out, "node_id").set_index("node_id")
    assert len(got) == 9 and H.coherence_error(out).first()["max_abs_error"] < 1e-9
    assert got.loc["total/b/t/b1", "reconciled_median"] == 0 and np.isnan(got.loc["total/b/t/b1", "roas_q50"])
    assert got.loc["total", "method"] == "joint_conformal" and got.loc["total/a/t/a0", "method"] == "marginal_conformal"
    q = got[QUANTILE_COLUMNS].to_numpy()
    assert (np.diff(q, axis=1) >= -1e-9).all() and q[:, 3] == pytest.approx(got["reconciled_median"].to_numpy())
    assert got.loc["total", "roas_q90"] == pytest.approx(got.loc["total", "q90"] / 30.0)


def test_short_history_falls_back_to_summed_quantiles(spark):
    out = H.reconcile(live(spark, tree_rows(1, 1)).drop("origin_date"), spark.createDataFrame(tree_rows(5, 0), SCHEMA))
    got = pdf(out).set_index("node_id")
    assert got.loc["total/a/t/a0", "method"] == "rescaled_sum" and got.loc["total/a/t/a0", "q05"] == pytest.approx(350.0)


def test_bands_are_calibrated_by_level(spark):
    held = [(h, d + 1000 * DAY, *r) for h, d, *r in tree_rows(60, 9)]
    out = pdf(H.calibration_by_level(live(spark, held), spark.createDataFrame(tree_rows(400, 3), SCHEMA))).set_index("level")
    assert out.loc["total", "n_observations"] == 60 and out.loc["campaign", "n_observations"] == 240
    assert (out["coverage_90"] - 0.9).abs().max() < 0.1 and (out["coverage_50"] - 0.5).abs().max() < 0.2


def test_tree_solution_equals_dense_least_squares(spark):
    rng = np.random.default_rng(4)
    leaves = [("a", "x", "1"), ("a", "x", "2"), ("a", "y", "3"), ("b", "z", "4")]
    df = spark.createDataFrame([(*l, 1.0) for l in leaves], "channel string, campaign_type string, campaign_id string, v double")
    nodes = pdf(H.rollup_tree(df, [F.sum("v").alias("v")]), "node_id")
    nodes["forecast"], nodes["variance"] = rng.uniform(5, 20, len(nodes)), rng.uniform(0.5, 3, len(nodes))
    bottom = ["total/" + "/".join(l) for l in leaves]
    s = np.array([[float(b == n or b.startswith(n + "/")) for b in bottom] for n in nodes["node_id"]])
    w = np.diag(1 / nodes["variance"])
    want = s @ np.linalg.solve(s.T @ w @ s, s.T @ w @ nodes["forecast"])
    got = pdf(H.wls_reconcile(spark.createDataFrame(nodes)), "node_id")
    assert got["reconciled"].to_numpy() == pytest.approx(want)


def test_residual_covariance_shrinks_towards_the_diagonal(spark):
    s = H.node_series(spark.createDataFrame(tree_rows(200, 3), SCHEMA))
    out = pdf(H.residual_covariance(s)).set_index(["node_a", "node_b"])
    wide = pdf(s).assign(r=lambda d: d["y"] - d["model"]).pivot(index="origin_date", columns="node_id", values="r")
    assert out.loc[("total/a", "total/a"), "covariance"] == pytest.approx(wide["total/a"].var())
    raw = wide["total/a"].cov(wide["total/b"])
    assert abs(out.loc[("total/a", "total/b"), "covariance"]) <= abs(raw) and 0 <= out["shrinkage"].iloc[0] <= 1


def test_residual_covariance_of_many_nodes_equals_numpy(spark):
    """Forty campaigns in blocks of about seven, one that never varies, one date that a campaign misses."""
    rng = np.random.default_rng(5)
    r = rng.normal(0, 1, (30, 40)) @ rng.normal(0, 1, (40, 40)) * 10
    r[:, 7] = 3.0
    rows = [(30, START + d * DAY, f"n{k:02d}", "campaign", float(r[d, k]) + 100, 100.0) for d in range(30) for k in range(40) if (d, k) != (4, 11)]
    series = spark.createDataFrame(rows, "horizon_days int, origin_date date, node_id string, level string, y double, model double").repartition(3)
    out = pdf(H.residual_covariance(series, "campaign", block=7))
    assert len(out) == 40 * 41 // 2 and set(out["n"]) == {29} and (out["node_a"] <= out["node_b"]).all()
    own = np.delete(r, 4, axis=0)
    s, n = own.std(axis=0, ddof=1), 29
    z = np.where(s > 1e-9, (own - own.mean(axis=0)) / np.where(s > 1e-9, s, 1), 0)
    i, j = np.triu_indices(40, 1)
    products = z[:, i] * z[:, j]
    corr = products.sum(axis=0) / (n - 1)
    shrink = min(1, max(0, (products.var(axis=0, ddof=1) * n * n / (n - 1) ** 3).sum() / (corr ** 2).sum()))
    want = {(f"n{a:02d}", f"n{b:02d}"): (1 - shrink) * c * s[a] * s[b] for a, b, c in zip(i, j, corr)} | {(f"n{a:02d}",) * 2: s[a] ** 2 for a in range(40)}
    got = {(a, b): c for a, b, c in zip(out["node_a"], out["node_b"], out["covariance"])}
    assert got.keys() == want.keys() and out["shrinkage"].iloc[0] == pytest.approx(shrink)
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)
