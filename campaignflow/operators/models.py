"""Forecast models on Spark ML: Tweedie and hurdle regressions, boosted trees, quantile forest."""

from collections.abc import Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignflow.functions.metrics import auc, gamma_deviance, tweedie_deviance
from campaignflow.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES, QUANTILE_COLUMNS, QUANTILES
from campaignflow.sources.workdir import stored

TARGET, WEIGHT = "target_revenue", "anomaly_weight"
# Tweedie variance powers tried.
TWEEDIE_POWERS = [1.1, 1.3, 1.5, 1.7, 1.9]
#: Directions that hold less than this share of the inputs' variance repeat others and are left out of the regressions.
LEAST_SHARE = 1e-4
SEED = 42


def prepare(frame: DataFrame) -> DataFrame:
    """Signed-log numeric inputs with missing values zero-filled, and a flag for each of them; trees are unaffected by the log."""
    numeric = {f"x_{c}": F.signum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
               * F.log1p(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))) for c in NUMERIC_FEATURES}
    flags = {f"na_{c}": F.col(c).isNull().cast("double") for c in NUMERIC_FEATURES}
    return frame.withColumns({**numeric, **flags})


def missing_somewhere(prepared: DataFrame) -> list[str]:
    """Inputs that are missing in some row, in the order of the schema: one aggregation over all rows."""
    found = prepared.agg(*[F.max(f"na_{c}").alias(c) for c in NUMERIC_FEATURES]).first()
    return [c for c in NUMERIC_FEATURES if found[c]]


def fit_encoder(prepared: DataFrame) -> PipelineModel:
    """``features`` for trees: every input, a flag for every input that is missing somewhere, and the categories one-hot.

    All of it comes from the rows it is fitted on; unseen categories get their own slot.
    """
    indexed, hot = [f"i_{c}" for c in CATEGORICAL_FEATURES], [f"h_{c}" for c in CATEGORICAL_FEATURES]
    flags = [f"na_{c}" for c in missing_somewhere(prepared)]
    return Pipeline(stages=[
        StringIndexer(inputCols=CATEGORICAL_FEATURES, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot),
        VectorAssembler(inputCols=[*[f"x_{c}" for c in NUMERIC_FEATURES], *flags, *hot], outputCol="features"),
    ]).fit(prepared)


def fit_basis(encoded: DataFrame) -> PipelineModel:
    """``core`` for regressions: ``features`` standardised and turned into uncorrelated directions.

    Inputs of very different scale that nearly repeat each other (sums over 7, 14, 28 days) would leave the least-squares
    steps of the regressions undetermined; directions that repeat others are left out, no input is.
    """
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(encoded)
    basis = PCA(k=scaler.mean.size, inputCol="scaled", outputCol="directions").fit(scaler.transform(encoded))
    kept = [i for i, v in enumerate(basis.explainedVariance.toArray()) if v > LEAST_SHARE]
    return PipelineModel(stages=[scaler, basis, VectorSlicer(inputCol="directions", outputCol="core", indices=kept)])


def input_weights(basis: PipelineModel, coefficients: Sequence[float]) -> np.ndarray:
    """Coefficients of ``core`` carried back to the slots of ``features``."""
    scaler, turned, slicer = basis.stages
    spread = scaler.std.toArray()
    back = turned.pc.toArray()[:, slicer.getIndices()] @ np.asarray(coefficients)
    return np.where(spread > 0, back / np.where(spread > 0, spread, 1), 0.0)


def mean_target(train: DataFrame) -> float:
    return train.agg(F.avg(TARGET).alias("m")).first()["m"] or 1.0


def fit_tweedie(train: DataFrame, power: float):
    """Log-link Tweedie regression on the target in units of its mean, and that unit."""
    unit = mean_target(train)
    glm = GeneralizedLinearRegression(
        family="tweedie", variancePower=power, linkPower=0.0, featuresCol="core", labelCol="units", weightCol=WEIGHT,
        regParam=0.01, maxIter=8, tol=1e-4)
    return glm.fit(train.withColumn("units", F.col(TARGET) / unit)), unit


def predict_tweedie(model, rows: DataFrame, name: str = "tweedie") -> DataFrame:
    glm, unit = model
    return glm.transform(rows).withColumn(name, F.col("prediction") * unit).drop("prediction")


def floored(prediction):
    """Point forecasts are not negative."""
    return F.greatest(F.col(prediction), F.lit(0.0))


#: Rounds of least squares in the sweep at most, the change of coefficients that ends it, and limits of starting means and of logs.
SWEEP_ROUNDS, SWEEP_TOLERANCE, START_MEAN, LOG_LIMIT, RIDGE = 8, 1e-4, 0.1, 30.0, 0.01
SWEEP_ROWS = "fold int, target double, weight double, role string, core array<double>"


def batch_inputs(batch: pa.RecordBatch) -> tuple:
    """Fold, target, weight, role and the inputs with a leading 1 of a batch of SWEEP_ROWS."""
    fold, target, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    core = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return fold, target, weight, batch.column(3).to_numpy(zero_copy_only=False), np.column_stack([np.ones(len(core)), core])


def step_sums(batches, state, powers):
    """Sums of the next weighted least-squares step of every (fold, power) over a partition's training rows."""
    units, coefficients = state.value
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        fold, target, weight, _, x = batch_inputs(batch)
        for f in np.unique(fold).tolist():
            own = fold == f
            xf, y, w = x[own], np.maximum(target[own], 0.0) / units[f], weight[own]
            for i, power in enumerate(powers):
                eta = np.log(np.maximum(y, START_MEAN)) if coefficients is None else np.clip(xf @ coefficients[f, i], -LOG_LIMIT, LOG_LIMIT)
                mean = np.exp(eta)
                work = w * mean ** (2 - power)
                xw = xf * work[:, None]
                sums = np.concatenate([(xw.T @ xf).ravel(), xw.T @ (eta + (y - mean) / mean), [work.sum()]])
                total[f, i] = total[f, i] + sums if (f, i) in total else sums
    yield from sum_rows(total)


def added_up(batches):
    """The sums of each (fold, power) that a partition holds, one after another."""
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for f, i, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            sums = np.frombuffer(raw)
            total[f, i] = total[f, i] + sums if (f, i) in total else sums
    yield from sum_rows(total)


def sum_rows(total: dict):
    for (f, i), sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([i], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["fold", "place", "sums"])


def solved(raw: bytes) -> np.ndarray:
    """Coefficients from the sums of a step; the ridge spares the constant."""
    sums = np.frombuffer(raw)
    k = int(np.sqrt(len(sums)))  # k * k + k + 1 numbers
    square, right, weight = sums[:k * k].reshape(k, k), sums[k * k:k * k + k], sums[-1]
    return np.linalg.solve(square + np.diag([1e-12 * weight] + [RIDGE * weight] * (k - 1)), right)


def sweep_tweedie(folds: DataFrame, powers=TWEEDIE_POWERS) -> DataFrame:
    """Mean validation deviance per power over the walk-forward folds in ``folds`` (columns fold, role).

    All fits, one per (fold, power), advance in the same passes: each pass sums every fit's next weighted least-squares
    step by partition, and the driver solves one small system per fit. Deviances of different powers have different
    scales, so powers compare by the deviance of power 1.5 of their forecasts.
    """
    spark, sums_type = folds.sparkSession, "fold int, place int, sums binary"
    rows = folds.select(F.col("fold").cast("int").alias("fold"), F.col(TARGET).cast("double").alias("target"), F.col(WEIGHT).cast("double").alias("weight"),
                        "role", vector_to_array("core").alias("core"))
    train = rows.where("role = 'train'")
    units = {r["fold"]: r["m"] or 1.0 for r in train.groupBy("fold").agg(F.avg("target").alias("m")).collect()}  # a row per fold
    coefficients = None
    for _ in range(SWEEP_ROUNDS):
        state = spark.sparkContext.broadcast((units, coefficients))
        sums = train.mapInArrow(partial(step_sums, state=state, powers=powers), sums_type)
        found = sums.repartition(len(units) * len(powers), "fold", "place").mapInArrow(added_up, sums_type).collect()
        now = {(r["fold"], r["place"]): solved(r["sums"]) for r in found}
        change = np.inf if coefficients is None else max(np.max(np.abs(now[k] - coefficients[k]) / np.maximum(1.0, np.abs(coefficients[k]))) for k in now)
        coefficients = now
        if change < SWEEP_TOLERANCE:
            break
    state = spark.sparkContext.broadcast((units, coefficients))

    def forecasts(batches):
        units, coefficients = state.value
        for batch in batches:
            fold, target, _, _, x = batch_inputs(batch)
            out = np.zeros((len(powers), len(fold)))
            for f in np.unique(fold).tolist():
                own = fold == f
                for i in range(len(powers)):
                    out[i, own] = np.exp(np.clip(x[own] @ coefficients[f, i], -LOG_LIMIT, LOG_LIMIT)) * units[f]
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(target), *map(pa.array, out)], names=["fold", "target", *names])

    names = [f"p{i}" for i in range(len(powers))]
    scored = rows.where("role = 'validation'").mapInArrow(forecasts, "fold int, target double, " + ", ".join(f"{n} double" for n in names))
    per_fold = scored.groupBy("fold").agg(F.array(*[
        F.struct(F.lit(float(p)).alias("power"), tweedie_deviance("target", n, p).alias("own"), tweedie_deviance("target", n, 1.5).alias("common"))
        for n, p in zip(names, powers, strict=True)]).alias("each")).select("fold", F.inline("each"))
    return per_fold.groupBy("power").agg(F.avg("own").alias("deviance"), F.avg("common").alias("common_deviance"), F.count(F.lit(1)).alias("n_folds"))


def best_power(swept: DataFrame) -> float:
    """The power with the least common deviance; the lower of equal ones."""
    return swept.orderBy("common_deviance", "power").first()["power"]


def side_by_side(fn, tasks: list, at_once: int = 4) -> list:
    """``fn`` of each task, a few at a time: the fits are Spark jobs that share the cluster."""
    with ThreadPool(min(at_once, max(1, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(fn), tasks)


def fit_hurdle(train: DataFrame):
    """P(revenue > 0) and the gamma mean of positive revenue, in units of the mean target."""
    unit = mean_target(train)
    marked = train.withColumns({"sold": (F.col(TARGET) > 0).cast("double"), "units": F.col(TARGET) / unit})
    classifier = LogisticRegression(
        featuresCol="core", labelCol="sold", weightCol=WEIGHT, regParam=0.01, maxIter=20, predictionCol="sold_class",
        probabilityCol="sold_p", rawPredictionCol="sold_raw").fit(marked)
    gamma = GeneralizedLinearRegression(
        family="gamma", link="log", featuresCol="core", labelCol="units", weightCol=WEIGHT, regParam=0.01, maxIter=8, tol=1e-4,
        predictionCol="positive_units").fit(marked.where("sold = 1"))
    return classifier, gamma, unit


def predict_hurdle(models, rows: DataFrame) -> DataFrame:
    classifier, gamma, unit = models
    scored = gamma.transform(classifier.transform(rows))
    share = vector_to_array("sold_p")[1]
    mean = F.greatest(F.col("positive_units"), F.lit(0.0)) * unit
    return scored.withColumns({"sold_share": share, "positive_mean": mean, "hurdle": share * mean}).drop(
        "sold_class", "sold_p", "sold_raw", "positive_units")


def hurdle_quality(scored: DataFrame) -> dict[str, float]:
    """AUC of the occurrence part and gamma deviance of the size part."""
    positive = scored.where(F.col(TARGET) > 0)
    return {"auc": auc(scored, TARGET, "sold_share"),
            "gamma_deviance": positive.agg(gamma_deviance(TARGET, "positive_mean").alias("d")).first()["d"]}


def boosted(rounds: int = 15) -> GBTRegressor:
    return GBTRegressor(labelCol=TARGET, weightCol=WEIGHT, maxIter=rounds, maxDepth=4, maxBins=32, seed=SEED,
                        subsamplingRate=0.7, featureSubsetStrategy="onethird", predictionCol="boosted")


# ---------------------------------------------------------------- quantile forest

#: Settings of the forest that ``choose_settings`` compares.
SETTINGS = [
    {"trees": 10, "depth": 8, "least": 40, "share": "onethird", "sample": 0.6},
    {"trees": 10, "depth": 6, "least": 40, "share": "onethird", "sample": 0.6},
    {"trees": 10, "depth": 8, "least": 100, "share": "onethird", "sample": 0.6},
    {"trees": 10, "depth": 8, "least": 15, "share": "onethird", "sample": 0.8},
    {"trees": 10, "depth": 8, "least": 40, "share": "sqrt", "sample": 0.6},
    {"trees": 10, "depth": 8, "least": 40, "share": "0.6", "sample": 0.8},
    {"trees": 20, "depth": 6, "least": 60, "share": "sqrt", "sample": 0.8},
]
#: All values are put in so many slices of about equal size, so that the largest leaf is no single task's work.
SLICES = 512


def fit_quantile_forest(train: DataFrame, settings: dict | None = None):
    """Forest, and a table (tree, leaf_id, q) with the weighted target quantiles of every leaf: trees x 2^depth rows at most."""
    use = settings or SETTINGS[0]
    forest = RandomForestRegressor(
        labelCol=TARGET, weightCol=WEIGHT, numTrees=use["trees"], maxDepth=use["depth"], maxBins=32, minInstancesPerNode=use["least"],
        subsamplingRate=use["sample"], featureSubsetStrategy=use["share"], leafCol="leaf", predictionCol="forest_mean", seed=SEED).fit(train)
    dealt = with_slice(train.withColumn("value", F.col(TARGET).cast("double")))
    placed = forest.transform(dealt).select("value", "slice", F.col(WEIGHT).cast("double").alias("w"), vector_to_array("leaf").cast("array<int>").alias("leaf"))
    # Read twice below.
    return forest, sliced_quantiles(stored(placed, "leaves").select("value", "slice", "w", F.posexplode("leaf").alias("tree", "leaf_id")))


def with_slice(rows: DataFrame, slices: int = SLICES) -> DataFrame:
    """``rows`` with ``slice``: how many of ``slices - 1`` approximate quantiles of all values are less than ``value``."""
    # A fixed number of cuts.
    found = rows.agg(F.percentile_approx("value", [i / slices for i in range(1, slices)], 20 * slices).alias("cuts")).first()["cuts"]
    cuts = np.array(found or [], dtype=float)

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, values.to_numpy()).astype(np.int32))

    return rows.withColumn("slice", place("value"))


def leaf_quantiles(placed: DataFrame, quantiles=QUANTILES, slices: int = SLICES) -> DataFrame:
    """Exact weighted quantiles of ``value`` by (tree, leaf_id): the least value at which the share of weight reaches each."""
    return sliced_quantiles(with_slice(placed, slices), quantiles)


def sliced_quantiles(dealt: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """``leaf_quantiles`` of rows that have their ``slice``.

    The weights of a leaf's slices add up before anything is sent. The sums show which slice holds each quantile; only the
    rows of those slices are shuffled, to be counted by value and summed in order. A slice holds its share of all rows,
    apart from equal values, so it bounds that work for every leaf, and one set of cuts serves all leaves and trees.
    """
    leaf = ["tree", "leaf_id"]
    sums = dealt.groupBy(*leaf, "slice").agg(F.sum("w").alias("inside"))
    before = F.coalesce(F.sum("inside").over(W.partitionBy(*leaf).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    whole = W.partitionBy(*leaf)
    sums = sums.withColumns({"before": before, "total": F.sum("inside").over(whole), "least": F.min("slice").over(whole)})

    def reached(weight, q):
        # Sums of weights in another order differ in their last digits: a billionth of the total is no difference.
        return weight + 1e-9 * F.col("total") >= q * F.col("total")

    # A leaf without any weight has all its quantiles at its least value.
    holds = [~reached(F.col("before"), q) & reached(F.col("before") + F.col("inside"), q) for q in quantiles]
    wanted = sums.where(reduce(Column.__or__, holds, (F.col("total") <= 0) & (F.col("slice") == F.col("least"))))
    # One row per leaf and quantile at most.
    near = dealt.join(F.broadcast(wanted.select(*leaf, "slice", "before", "total")), [*leaf, "slice"])
    counts = near.groupBy(*leaf, "slice", "value").agg(F.sum("w").alias("w"), F.first("before").alias("before"), F.first("total").alias("total"))
    run = F.col("before") + F.sum("w").over(W.partitionBy(*leaf, "slice").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    summed = counts.withColumn("run", run)
    return summed.groupBy(*leaf).agg(F.array(*[F.min(F.when(reached(F.col("run"), q) | (F.col("total") <= 0), F.col("value"))) for q in quantiles]).alias("q"))


def leaf_table(leaves: DataFrame) -> np.ndarray:
    """The quantiles as an array (tree, leaf, quantile): at most trees x 2^depth x 7 numbers, whatever the training data."""
    rows = leaves.collect()
    table = np.zeros((max(r["tree"] for r in rows) + 1, max(int(r["leaf_id"]) for r in rows) + 1, len(rows[0]["q"])))
    for r in rows:
        table[r["tree"], int(r["leaf_id"])] = r["q"]
    return table


def predict_quantiles(forest, table: np.ndarray, rows: DataFrame) -> DataFrame:
    """``rows`` with the quantile columns: each quantile averaged over the leaves that a row falls into, at least 0.

    Averages of ordered values stay ordered, so nothing can cross. The leaf table goes to the tasks once; a row is
    looked up where it stands, without a shuffle or a join.
    """
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def look_up(leaves: pd.Series) -> pd.Series:
        own = shared.value
        if not len(leaves):
            return pd.Series([], dtype=object)
        at = np.stack(leaves.to_numpy()).astype(np.int64)
        return pd.Series(list(np.maximum(own[np.arange(own.shape[0]), at].mean(axis=1), 0.0)))

    placed = forest.transform(rows).withColumn("q", look_up(vector_to_array("leaf")))
    names = [c for c in rows.columns if c not in QUANTILE_COLUMNS]
    return placed.select(*names, *[F.col("q")[i].alias(c) for i, c in enumerate(QUANTILE_COLUMNS)])


def importance(spark, forest, names: list[str], top: int = 10) -> DataFrame:
    """Gain importance of the forest's inputs, strongest first."""
    ranked = sorted(zip(names, forest.featureImportances.toArray()), key=lambda p: (-p[1], p[0]))[:top]
    return spark.createDataFrame([(i + 1, n, float(v)) for i, (n, v) in enumerate(ranked)], "rank int, feature string, gain double")


def input_names(assembled: DataFrame) -> list[str]:
    """Name of every slot of the feature vector, from the assembler's metadata."""
    attrs = assembled.schema["features"].metadata["ml_attr"]["attrs"]
    slots = [a for group in attrs.values() for a in group]
    return [a["name"] for a in sorted(slots, key=lambda a: a["idx"])]
