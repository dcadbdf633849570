"""Forest leaves, scoring in the row, folds, settings, attributions and the bundle on small frames."""

import datetime

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from campaignflow.functions import metrics as M
from campaignflow.operators import calibration as C
from campaignflow.operators import models as D
from campaignflow.plans import training as T
from campaignflow.schema import NUMERIC_FEATURES, QUANTILE_COLUMNS, QUANTILES
from campaignflow.sources.bundle import read_bundle, write_bundle

DAY = datetime.timedelta(days=1)
START = datetime.date(2024, 1, 1)
SMALL = {"trees": 4, "depth": 4, "least": 5, "share": "onethird", "sample": 0.8}


def weighted_quantile(values, weights, q):
    order = np.argsort(values, kind="stable")
    share = np.cumsum(np.asarray(weights)[order]) / np.sum(weights)
    return np.asarray(values)[order][np.searchsorted(share + 1e-9, q)]


@pytest.mark.parametrize("slices", [64, 3])
def test_leaves_are_exact_weighted_quantiles(spark, slices):
    rng = np.random.default_rng(2)
    rows = [(int(t), int(l), float(v), float(w)) for t, l, v, w in zip(
        rng.integers(0, 2, 4000), np.minimum(rng.integers(0, 12, 4000), 4), np.round(rng.gamma(0.7, 30, 4000), 1), rng.choice([0.25, 1.0, 3.0], 4000))]
    rows += [(0, 9, 0.0, 1.0)] * 500 + [(1, 9, 5.0, 0.0), (1, 9, 7.0, 0.0), (1, 8, 2.0, 1.0)]
    placed = spark.createDataFrame(rows, "tree int, leaf_id int, value double, w double")
    got = {(r["tree"], r["leaf_id"]): r["q"] for r in D.leaf_quantiles(placed, slices=slices).collect()}
    for key in {r[:2] for r in rows} - {(1, 9)}:
        own = [r for r in rows if r[:2] == key]
        assert got[key] == [weighted_quantile([r[2] for r in own], [r[3] for r in own], q) for q in QUANTILES]
    assert got[0, 9] == [0.0] * 7 and got[1, 9] == [5.0] * 7


def test_leaves_of_narrow_range_share_one_set_of_cuts(spark):
    """Leaves whose values lie far apart, in a slice or two each: still exact, without a list of cuts per row and leaf."""
    rng = np.random.default_rng(9)
    rows = [(t, l, float(v), float(w)) for t in range(2) for l in range(6) for v, w in zip(np.round(10.0 ** l + rng.random(300), 3), rng.choice([0.5, 1.0], 300))]
    placed = D.with_slice(spark.createDataFrame(rows, "tree int, leaf_id int, value double, w double"), 8)
    assert placed.select("slice").distinct().count() <= 8
    out = D.sliced_quantiles(placed)
    assert "lambda" not in out._jdf.queryExecution().analyzed().toString()
    got = {(r["tree"], r["leaf_id"]): r["q"] for r in out.collect()}
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        assert got[key] == [weighted_quantile([r[2] for r in own], [r[3] for r in own], q) for q in QUANTILES]


@pytest.fixture(scope="module")
def frame(spark):
    """Rows with every feature; three are missing here and there, and the target follows two of them."""
    rng = np.random.default_rng(7)
    n = 1500
    values = rng.gamma(2, 50, (n, len(NUMERIC_FEATURES)))
    gone = rng.random((n, 3)) < 0.2
    rows = []
    for i in range(n):
        x = dict(zip(NUMERIC_FEATURES, map(float, values[i])))
        x["horizon_days"] = float([30, 60, 90][i % 3])
        # Nearly the same input again: least squares on the plain inputs would not be determined.
        x["revenue_roll_sum_28"] = x["revenue_roll_mean_28"] * 28
        for k, c in enumerate(("daily_budget", "trailing_roas_7", "cpm_roll_28")):
            if gone[i, k]:
                x[c] = None
        y = 10 * x["revenue_roll_mean_28"] * (0.2 if gone[i, 0] else 1) + float(rng.gamma(1, 20))
        rows.append((f"a::{i % 25}", START + (i // 3 % 400) * DAY, f"c{i % 2}", ["x", "y", "z"][i % 25 % 3], 0.0 if i % 17 == 0 else y, 1.0 + i % 2, *[x[c] for c in NUMERIC_FEATURES]))
    schema = ("campaign_id string, origin_date date, channel string, campaign_type string, target_revenue double, anomaly_weight double, "
              + ", ".join(f"{c} double" for c in NUMERIC_FEATURES))
    # Horizons must be whole numbers for the calendar arithmetic of the folds.
    return spark.createDataFrame(rows, schema).withColumn("horizon_days", F.col("horizon_days").cast("int")).persist()


def test_flags_of_all_missing_inputs_and_scoring_without_shuffle(spark, frame):
    prepared = D.prepare(frame)
    assert set(D.missing_somewhere(prepared)) == {"daily_budget", "trailing_roas_7", "cpm_roll_28"}
    encoder = D.fit_encoder(prepared)
    rows = encoder.transform(prepared)
    names = D.input_names(rows)
    assert {f"x_{c}" for c in NUMERIC_FEATURES} <= set(names) and {"na_daily_budget", "na_trailing_roas_7", "na_cpm_roll_28"} <= set(names)
    forest, leaves = D.fit_quantile_forest(rows, SMALL)
    table = D.leaf_table(leaves)
    scored = D.predict_quantiles(forest, table, rows.select("campaign_id", "target_revenue", "features"))
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    got = scored.toPandas()
    assert (np.diff(got[QUANTILE_COLUMNS].to_numpy(), axis=1) >= 0).all()
    leaf = forest.transform(rows).select("leaf").toPandas()["leaf"]
    want = np.array([[table[t, int(l)] for t, l in enumerate(v.toArray())] for v in leaf]).mean(axis=1)
    assert np.allclose(got[QUANTILE_COLUMNS].to_numpy(), want)
    unseen = encoder.transform(D.prepare(frame.limit(3).withColumn("channel", F.lit("new"))))
    assert D.predict_quantiles(forest, table, unseen.select("features")).count() == 3


def test_regressions_see_all_inputs_and_give_them_back(spark, frame):
    encoder = D.fit_encoder(D.prepare(frame))
    rows = encoder.transform(D.prepare(frame))
    basis = D.fit_basis(rows)
    turned = basis.transform(rows).persist()
    model, _ = D.fit_tweedie(turned, 1.5)
    weights = D.input_weights(basis, model.coefficients.toArray())
    link = model.setLinkPredictionCol("link").transform(turned).select("features", "link").toPandas()
    x = np.array([v.toArray() for v in link["features"]])
    shown = (x - x.mean(axis=0)) @ weights
    assert np.allclose(shown, link["link"] - link["link"].mean(), atol=1e-6)
    strongest = max(zip(D.input_names(rows), np.abs(weights) * x.std(axis=0)), key=lambda p: p[1])[0]
    assert strongest in ("x_revenue_roll_mean_28", "x_revenue_roll_sum_28", "na_daily_budget")


def test_attributions_by_group_and_total(spark):
    rng = np.random.default_rng(3)
    data = [(h, c, float(a), float(b)) for h in (30, 60) for c in "pq" for a, b in rng.normal(size=(30, 2))]
    rows = spark.createDataFrame(data, "horizon_days int, channel string, a double, b double")
    got = {(r["horizon_days"], r["channel"], r["feature"]): r for r in C.linear_attributions(rows, {"one": [(2.0, "a")], "both": [(1.0, "a"), (-3.0, "b")]}, by="channel", within=["horizon_days"]).collect()}
    assert len(got) == 12
    for h in (30, 60):
        own = np.array([r[2:] for r in data if r[0] == h])
        c = (own - own.mean(axis=0)) @ [1.0, -3.0]
        mine = np.array([r[1] == "p" for r in data if r[0] == h])
        assert got[h, "total", "both"]["mean_abs"] == pytest.approx(np.abs(c).mean())
        assert got[h, "p", "both"]["mean_signed"] == pytest.approx(c[mine].mean()) and got[h, "p", "both"]["n_rows"] == 30


def test_folds_fit_on_their_own_training_rows(spark, frame, monkeypatch):
    seen = []
    fit = D.fit_quantile_forest

    def watched(train, settings=None):
        seen.append(train.agg(F.sum("target_revenue")).first()[0])
        return fit(train, SMALL)

    monkeypatch.setattr(D, "fit_quantile_forest", watched)
    monkeypatch.setattr(D, "side_by_side", lambda fn, tasks, at_once=4: [fn(t) for t in tasks])
    rows = T.fold_rows(frame, "grouped", 3)
    out = T.fold_predictions(frame, "grouped", 3).toPandas()
    assert len(out) == frame.count() and set(out["fold"]) == {0, 1, 2}
    assert all(len(set(g["fold"])) == 1 for _, g in out.groupby("campaign_id"))
    want = {r["fold"]: r["t"] for r in rows.where("role = 'train'").groupBy("fold").agg(F.sum("target_revenue").alias("t")).collect()}
    assert seen == pytest.approx([want[f] for f in sorted(want)])
    # Validation targets turned upside down move no forecast of the walk-forward folds that start after them.
    walk = T.fold_rows(frame, "walk_forward", 2)
    assert walk.where("role = 'validation'").select("fold").distinct().count() == 2
    cut = walk.where("fold = 0 AND role = 'validation'").agg(F.min("origin_date")).first()[0]
    turned = frame.withColumn("target_revenue", F.when(F.col("origin_date") >= F.lit(cut), 1e6).otherwise(F.col("target_revenue")))
    first, second = (T.fold_predictions(f, "walk_forward", 2).where("fold = 0").orderBy(*T.ROW, "q50").select(*QUANTILE_COLUMNS).toPandas() for f in (frame, turned))
    assert np.allclose(first, second)


@pytest.mark.parametrize("kind, n", [("grouped", 3), ("walk_forward", 4)])
def test_fold_parts_are_the_fold_rows_without_copies(spark, frame, kind, n):
    rows, parts = T.fold_rows(frame, kind, n), T.fold_parts(frame, kind, n)
    names = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    assert list(parts) == names and len(names) > 1
    for fold, part in parts.items():
        shown = [*T.ROW, "role", "target_revenue"]
        assert sorted(part.select(*shown).collect()) == sorted(rows.where(F.col("fold") == fold).select(*shown).collect())
        assert "Generate" not in part._jdf.queryExecution().analyzed().toString()


def test_validation_report(spark):
    rows = [(k, f, 30, y, p, 1.0) for k, p in (("walk_forward", 9.0), ("grouped", 8.0)) for f in range(2) for y in (10.0, 10.0)]
    frame = spark.createDataFrame(rows, "kind string, fold int, horizon_days int, target_revenue double, p double, revenue_roll_mean_28 double")
    frame = frame.withColumns({c: F.col("p") for c in QUANTILE_COLUMNS})
    got = {r["kind"]: r for r in T.validation_report(frame).collect()}
    assert got["grouped"]["crps_gap"] == pytest.approx(1.0) and got["grouped"]["wape"] == pytest.approx(0.2) and got["walk_forward"]["n_folds"] == 2


def test_settings_winner_is_the_arg_min(spark, frame, monkeypatch):
    monkeypatch.setattr(T, "weighted_frame", lambda canonical: canonical.withColumn("split", F.lit("train")))
    settings = [SMALL, {**SMALL, "depth": 1}, {**SMALL, "least": 200}]
    losses, best = T.choose_settings(frame, settings, n_folds=2)
    table = losses.groupBy("setting").agg(F.avg("loss").alias("loss"), F.count("*").alias("n")).toPandas().sort_values(["loss", "setting"])
    assert set(table["n"]) == {2} and best == settings[int(table["setting"].iloc[0])]


def test_sweep_equals_plain_fits(spark):
    """Every (fold, power) of the sweep against least squares in numpy, iterated on that fold's rows alone."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = np.where(rng.random(400) < 0.3, 0.0, np.exp(x @ [0.4, -0.3, 0.1] + rng.normal(0, 0.3, 400)) * 50)
    w = rng.uniform(0.2, 1, 400)
    roles = [(f, "train" if i < 200 + 80 * f else "validation", i) for f in range(2) for i in range(400)]
    data = [(f, role, Vectors.dense(x[i]), float(y[i]), float(w[i])) for f, role, i in roles]
    folds = spark.createDataFrame(data, ["fold", "role", "core", "target_revenue", "anomaly_weight"]).repartition(5)
    got = {r["power"]: r for r in D.sweep_tweedie(folds, [1.3, 1.5]).collect()}
    for power in (1.3, 1.5):
        losses = []
        for f in range(2):
            n = 200 + 80 * f
            a, unit = np.column_stack([np.ones(n), x[:n]]), y[:n].mean()
            t, beta = y[:n] / unit, None
            for _ in range(D.SWEEP_ROUNDS):
                eta = np.log(np.maximum(t, 0.1)) if beta is None else a @ beta
                mu = np.exp(eta)
                k = w[:n] * mu ** (2 - power)
                beta = np.linalg.solve((a * k[:, None]).T @ a + 0.01 * k.sum() * np.diag([0, 1, 1, 1]), (a * k[:, None]).T @ (eta + (t - mu) / mu))
            m, t = np.exp(np.column_stack([np.ones(400 - n), x[n:]]) @ beta) * unit, y[n:]
            losses.append(2 * np.mean(t ** (2 - power) / ((1 - power) * (2 - power)) - t * m ** (1 - power) / (1 - power) + m ** (2 - power) / (2 - power)))
        assert got[power]["n_folds"] == 2 and abs(got[power]["deviance"] / np.mean(losses) - 1) < 1e-3


def test_sweep_and_point_models(spark, frame):
    labelled = frame.withColumn("split", F.when(F.col("origin_date") < F.lit(START + 250 * DAY), "train").when(F.col("origin_date") < F.lit(START + 330 * DAY), "calibration").otherwise("holdout"))
    _, rows = T.assembled(labelled, "split = 'train'")
    trained = {"frame": rows}
    point = T.train_point(trained)
    assert point["power"] in D.TWEEDIE_POWERS and point["winner"] in (*T.POINT, "blend")
    held = T.predict_points(point["models"], point["basis"].transform(rows.where("split = 'holdout'")))
    row = held.agg(F.min("tweedie").alias("low"), M.wape("target_revenue", point["winner"]).alias("wape"), F.count("*").alias("n")).first()
    assert row["low"] >= 0 and row["wape"] < 0.9 and row["n"] > 100


def test_bundle_reads_back_and_refuses_damage(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "swept_power", lambda rows: (1.5, None))
    labelled = frame.withColumn("split", F.when(F.col("origin_date") < F.lit(START + 250 * DAY), "train").otherwise("calibration"))
    encoder, rows = T.assembled(labelled, "split = 'train'")
    forest, leaves = D.fit_quantile_forest(rows.where("split = 'train'"), SMALL)
    table = D.leaf_table(leaves)
    scored = D.predict_quantiles(forest, table, rows.where("split = 'calibration'"))
    trained = {"encoder": encoder, "forest": forest, "leaves": table, "cqr": C.fit_cqr(spark, scored), "frame": rows}
    path = str(tmp_path / "bundle")
    write_bundle({**trained, "point": T.train_point(trained)}, path)
    back = read_bundle(spark, path)
    assert np.array_equal(back["leaves"], table) and sorted(back["cqr"].collect()) == sorted(trained["cqr"].collect())
    again = D.predict_quantiles(back["forest"], back["leaves"], back["encoder"].transform(D.prepare(labelled)).select("features"))
    assert again.count() == frame.count() and "winner" in back["point"]
    spark.createDataFrame([(0, 0, [1.0])], "tree int, leaf_id int, q array<double>").write.mode("overwrite").parquet(f"{path}/leaves")
    with pytest.raises(ValueError, match="lacks rows"):
        read_bundle(spark, path)
    with pytest.raises(ValueError, match="no finished bundle"):
        read_bundle(spark, str(tmp_path / "nothing"))
