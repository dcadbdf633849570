"""Train, calibrate, evaluate: the offline plan from canonical rows to models and reports."""

from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignflow.functions import metrics as M
from campaignflow.functions.scalars import safe_ratio
from campaignflow.operators import calibration as C
from campaignflow.operators import features as X
from campaignflow.operators import models as D
from campaignflow.operators import segments as S
from campaignflow.operators import splits as P
from campaignflow.operators.daily import group_day
from campaignflow.schema import CATEGORICAL_FEATURES, FEATURES, HORIZONS, NUMERIC_FEATURES, QUANTILE_COLUMNS
from campaignflow.sources.workdir import stored

ROW = ["campaign_id", "origin_date", "horizon_days"]


def weighted_frame(canonical: DataFrame, horizons=HORIZONS, stride: int = 1) -> DataFrame:
    """Training frame with the anomaly weight and the chronological split label."""
    frame = X.training_frame(canonical, horizons, stride)
    weighted = S.overlap_weights(frame, S.anomalous_segments(group_day(canonical)))
    return P.chronological_split(weighted)


KEPT = [*ROW, "channel", "campaign_type", "target_revenue", "revenue_roll_mean_28", "features", "anomaly_weight"]


def assembled(frame: DataFrame, fitted_on: str = "true") -> tuple:
    """Encoder fitted on the rows that ``fitted_on`` selects, and the frame with its vectors, persisted.

    Only what the models read is kept; they pass over these rows many times.
    """
    extra = [c for c in ("split", "fold", "role") if c in frame.columns]
    kept = [c for c in KEPT if c in frame.columns]
    rows = frame.select(*dict.fromkeys([*kept, *extra, *FEATURES])).persist(StorageLevel.MEMORY_AND_DISK)
    prepared = D.prepare(rows)
    encoder = D.fit_encoder(prepared.where(fitted_on))
    out = encoder.transform(prepared).select(*KEPT, *extra).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    rows.unpersist()
    return encoder, out


def train_forest(canonical: DataFrame, settings: dict | None = None):
    """Quantile forest on the training rows, its CQR correction from the calibration rows, and the frame."""
    encoder, frame = assembled(weighted_frame(canonical), "split = 'train'")
    forest, leaves = D.fit_quantile_forest(frame.where("split = 'train'"), settings)
    table = D.leaf_table(leaves)
    scored = D.predict_quantiles(forest, table, frame.where("split = 'calibration'").select(*ROW, "target_revenue", "features"))
    fit = C.fit_cqr(canonical.sparkSession, scored)
    return {"encoder": encoder, "frame": frame, "forest": forest, "leaves": table, "cqr": fit}


def evaluate_forest(trained) -> DataFrame:
    """Holdout accuracy per horizon, raw and calibrated, beside the pace baseline."""
    held = trained["frame"].where("split = 'holdout'").select(*ROW, "target_revenue", "revenue_roll_mean_28", "features")
    raw = D.predict_quantiles(trained["forest"], trained["leaves"], held).drop("features")
    fixed = C.apply_cqr(raw, trained["cqr"])
    y = "target_revenue"
    both = raw.withColumn("stage", F.lit("raw")).unionByName(fixed.withColumn("stage", F.lit("calibrated")))
    return both.groupBy("stage", "horizon_days").agg(
        F.count(F.lit(1)).alias("n_rows"), M.crps(y, QUANTILE_COLUMNS).alias("crps"), M.wape(y, "q50").alias("wape"),
        M.wape(y, M.naive_pace()).alias("naive_wape"), M.coverage(y, "q05", "q95").alias("coverage_90"),
        M.coverage(y, "q10", "q90").alias("coverage_80"), M.coverage(y, "q25", "q75").alias("coverage_50"))


POINT = ("tweedie", "hurdle", "boosted")


def with_basis(frame: DataFrame) -> tuple:
    """The regressions' basis, fitted on the training rows, and the frame with ``core``, persisted."""
    basis = D.fit_basis(frame.where("split = 'train'"))
    return basis, basis.transform(frame).drop("scaled", "directions").persist(StorageLevel.MEMORY_AND_DISK)


def swept_power(frame: DataFrame, n_folds: int = 4) -> tuple[float, DataFrame]:
    """The Tweedie power that the walk-forward folds of the rows before the holdout choose, and the sweep."""
    seen = frame.where("split IN ('train', 'calibration')").drop("split")
    swept = D.sweep_tweedie(P.walk_forward_roles(seen, n_folds=n_folds))
    swept = frame.sparkSession.createDataFrame(swept.collect(), swept.schema)  # one row per power
    return D.best_power(swept), swept


def fit_points(train: DataFrame, power: float) -> dict:
    return {"tweedie": D.fit_tweedie(train, power), "hurdle": D.fit_hurdle(train), "boosted": D.boosted().fit(train)}


def predict_points(models: dict, rows: DataFrame) -> DataFrame:
    """``rows`` with a non-negative forecast of each model, and their equal-weight blend."""
    scored = models["boosted"].transform(D.predict_hurdle(models["hurdle"], D.predict_tweedie(models["tweedie"], rows)))
    scored = scored.withColumns({c: D.floored(c) for c in POINT})
    return scored.withColumn("blend", sum(F.col(c) for c in POINT) / len(POINT))


def point_candidates(frame: DataFrame, power: float | None = None) -> tuple[DataFrame, float]:
    """Fit the three point models on the training rows and score them on the calibration rows; the power is swept unless given."""
    power = swept_power(frame)[0] if power is None else power
    return predict_points(fit_points(frame.where("split = 'train'"), power), frame.where("split = 'calibration'")), power


def train_point(trained) -> dict:
    """The point model of the bundle: candidates compared on the calibration rows, then refitted on training and calibration rows.

    ``winner`` names the candidate whose forecast is the point forecast.
    """
    basis, frame = with_basis(trained["frame"])
    held, power = point_candidates(frame)
    losses = C.compare_candidates(held, {c: c for c in POINT}, "tweedie").first()
    models = fit_points(frame.where("split IN ('train', 'calibration')"), power)
    frame.unpersist()
    return {"basis": basis, "models": models, "winner": losses["winner"], "power": power}


# ---------------------------------------------------------------- models inside validation

def fold_rows(frame: DataFrame, kind: str, n_folds: int) -> DataFrame:
    """``frame`` once per fold it takes part in, with ``fold`` and ``role``: walk-forward by date or grouped by campaign."""
    if kind == "walk_forward":
        return P.walk_forward_roles(frame, n_folds=n_folds).drop("cutoff")
    folds = P.campaign_folds(frame, n_folds).select("campaign_id", F.col("fold").alias("own"))
    each = F.explode(F.array(*[F.lit(i) for i in range(n_folds)])).alias("fold")
    return frame.join(folds, "campaign_id").select("*", each).withColumn(
        "role", F.when(F.col("fold") == F.col("own"), "validation").otherwise("train")).drop("own")


def fold_parts(frame: DataFrame, kind: str, n_folds: int) -> dict[int, DataFrame]:
    """The rows of ``fold_rows`` by fold, each a selection of ``frame``: no row is copied for the folds that are not asked for."""
    if kind == "walk_forward":
        # A row per fold.
        cutoffs = {r["fold"]: r["cutoff"] for r in P.usable_folds(frame, n_folds=n_folds).collect()}
        return {f: frame.withColumns({"fold": F.lit(f), "role": P.fold_role(F.lit(cutoffs[f]))}).where(F.col("role").isNotNull()) for f in sorted(cutoffs)}
    own = stored(P.campaign_folds(frame, n_folds).select("campaign_id", F.col("fold").alias("own")), "folds")
    placed = frame.join(own, "campaign_id")
    return {f: placed.withColumns({"fold": F.lit(f), "role": F.when(F.col("own") == f, "validation").otherwise("train")}).drop("own")
            for f in (range(n_folds) if own.head(1) else ())}


def fold_predictions(frame: DataFrame, kind: str, n_folds: int, settings: dict | None = None) -> DataFrame:
    """Quantiles for the validation rows of every fold, each from an encoder and a forest fitted on its fold's training rows.

    ``frame`` holds features, target and weight. Folds are fitted side by side, and nothing of a fold's validation rows
    reaches its models: scales, categories, directions and flags come from the fold's training rows, too.
    """
    parts = fold_parts(frame if "x_horizon_days" in frame.columns else D.prepare(frame), kind, n_folds)

    def one(fold):
        part = parts[fold]
        train = part.where("role = 'train'")
        encoder = D.fit_encoder(train)
        # The forest passes over its rows many times.
        vectors = encoder.transform(train).select("features", "target_revenue", "anomaly_weight").persist(StorageLevel.MEMORY_AND_DISK)
        forest, leaves = D.fit_quantile_forest(vectors, settings)
        table = D.leaf_table(leaves)
        vectors.unpersist()
        held = encoder.transform(part.where("role = 'validation'")).select(*ROW, "target_revenue", "revenue_roll_mean_28", "fold", "features")
        return D.predict_quantiles(forest, table, held).drop("features").withColumn("kind", F.lit(kind))

    return reduce(DataFrame.unionByName, D.side_by_side(one, list(parts)))


def out_of_fold(canonical: DataFrame, walks: int = 4, groups: int = 5, settings: dict | None = None) -> DataFrame:
    """Validation forecasts of walk-forward and grouped folds over the rows before the holdout, written to the shared folder."""
    frame = weighted_frame(canonical).where("split IN ('train', 'calibration')")
    kept = dict.fromkeys([*[c for c in KEPT if c in frame.columns], *CATEGORICAL_FEATURES])
    # Prepared once for all folds: nothing in these columns depends on other rows.
    frame = stored(D.prepare(frame).select(*kept, *[f"{k}_{c}" for k in ("x", "na") for c in NUMERIC_FEATURES]), "prepared")
    both = fold_predictions(frame, "walk_forward", walks, settings).unionByName(fold_predictions(frame, "grouped", groups, settings))
    return stored(both, "out-of-fold")


def fold_report(predictions: DataFrame) -> DataFrame:
    """Accuracy of every fold."""
    y = "target_revenue"
    return predictions.groupBy("kind", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), M.crps(y, QUANTILE_COLUMNS).alias("crps"), M.wape(y, "q50").alias("wape"),
        M.wape(y, M.naive_pace()).alias("naive_wape"), M.coverage(y, "q05", "q95").alias("coverage_90"), M.coverage(y, "q10", "q90").alias("coverage_80"))


def validation_report(predictions: DataFrame) -> DataFrame:
    """Mean accuracy per kind of folds, and how much worse unseen campaigns fare: (grouped - walk-forward) / walk-forward CRPS."""
    names = ["crps", "wape", "naive_wape", "coverage_90", "coverage_80"]
    per_kind = fold_report(predictions).groupBy("kind").agg(F.count(F.lit(1)).alias("n_folds"), *[F.avg(c).alias(c) for c in names])
    gap = per_kind.agg(*[F.max(F.when(F.col("kind") == k, F.col("crps"))).alias(k) for k in ("walk_forward", "grouped")]).select(
        safe_ratio(F.col("grouped") - F.col("walk_forward"), "walk_forward").alias("crps_gap"))
    # One row on the broadcast side.
    return per_kind.join(F.broadcast(gap))


def choose_settings(canonical: DataFrame, settings: list[dict] | None = None, n_folds: int = 2, trees: int | None = None) -> tuple[DataFrame, dict]:
    """Mean pinball loss at the median of every setting over walk-forward folds of the training rows, and the best setting.

    The losses of all folds and settings are a table; the winner is its arg-min, the earlier of equal settings. With ``trees``,
    settings are compared at that number of trees, which changes the noise of all of them alike.
    """
    settings = D.SETTINGS if settings is None else settings
    frame = weighted_frame(canonical).where("split = 'train'")
    rows = frame.select(*dict.fromkeys([*[c for c in KEPT if c in frame.columns], *FEATURES])).persist(StorageLevel.MEMORY_AND_DISK)
    folds = {}
    for fold, part in fold_parts(D.prepare(rows), "walk_forward", n_folds).items():
        encoder = D.fit_encoder(part.where("role = 'train'"))
        folds[fold] = encoder.transform(part).select("role", "features", "target_revenue", "anomaly_weight").persist(StorageLevel.MEMORY_AND_DISK)

    def measure(task):
        fold, i = task
        forest, leaves = D.fit_quantile_forest(folds[fold].where("role = 'train'"), settings[i] | ({"trees": trees} if trees else {}))
        held = D.predict_quantiles(forest, D.leaf_table(leaves), folds[fold].where("role = 'validation'"))
        return (fold, i, held.agg(M.pinball("target_revenue", "q50", 0.5).alias("loss")).first()["loss"])

    losses = canonical.sparkSession.createDataFrame(
        D.side_by_side(measure, [(f, i) for f in folds for i in range(len(settings))]), "fold int, setting int, loss double")
    for part in (*folds.values(), rows):
        part.unpersist()
    best = losses.groupBy("setting").agg(F.avg("loss").alias("loss")).orderBy("loss", "setting").first()
    return losses, settings[best["setting"]]


# ---------------------------------------------------------------- drivers

def driver_attributions(canonical: DataFrame, power: float = 1.5, top: int = 5) -> DataFrame:
    """Drivers of the Tweedie forecast on the holdout rows per horizon, for the total and each channel.

    The regression sees uncorrelated directions; its coefficients are carried back to the inputs. A feature's own flag for
    missing values belongs to it, and a category's slots are one feature.
    """
    _, frame = assembled(weighted_frame(canonical), "split = 'train'")
    basis, turned = with_basis(frame)
    model, _ = D.fit_tweedie(turned.where("split = 'train'"), power)
    names, weights = D.input_names(frame), D.input_weights(basis, model.coefficients.toArray())
    turned.unpersist()
    held = frame.where("split = 'holdout'").withColumn("v", vector_to_array("features"))
    held = held.select("horizon_days", "channel", *[F.col("v")[i].alias(f"slot{i}") for i in range(len(names))])
    terms = {}
    for i, (name, weight) in enumerate(zip(names, weights, strict=True)):
        feature = next((c for c in CATEGORICAL_FEATURES if name.startswith(f"h_{c}")), name.removeprefix("x_").removeprefix("na_"))
        terms.setdefault(feature, []).append((weight, f"slot{i}"))
    return C.linear_attributions(held, terms, by="channel", top=top, within=["horizon_days"])
