"""Model bundle: fitted Spark ML models and parameter tables under one path, complete or refused."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import GBTRegressionModel, GeneralizedLinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession

VERSION = 1
MANIFEST = "part string, kind string, n_rows long, number double, name string"
KINDS = {c.__name__: c for c in (PipelineModel, RandomForestRegressionModel, GeneralizedLinearRegressionModel, LogisticRegressionModel, GBTRegressionModel)}


def leaf_rows(spark: SparkSession, table: np.ndarray) -> DataFrame:
    """The leaf table, bounded by trees x 2^depth, as rows."""
    return spark.createDataFrame(
        [(t, leaf, q.tolist()) for t, tree in enumerate(table) for leaf, q in enumerate(tree)], "tree int, leaf_id int, q array<double>")


def write_bundle(trained: dict, path: str) -> None:
    """Write every part, then the manifest: a bundle without one was not finished.

    Tables (``cqr``, and where present curves, bounds and importances) are DataFrames; ``leaves`` is an array.
    """
    spark = trained["cqr"].sparkSession
    models = {"encoder": trained["encoder"], "forest": trained["forest"]}
    notes = [("version", "number", None, float(VERSION), None)]
    if "point" in trained:
        own = trained["point"]["models"]
        classifier, gamma, unit = own["hurdle"]
        models |= {"tweedie": own["tweedie"][0], "hurdle_share": classifier, "hurdle_size": gamma, "boosted": own["boosted"], "basis": trained["point"]["basis"]}
        notes += [("tweedie_unit", "number", None, own["tweedie"][1], None), ("hurdle_unit", "number", None, unit, None),
                  ("power", "number", None, trained["point"]["power"], None), ("winner", "name", None, None, trained["point"]["winner"])]
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
        notes.append((name, type(model).__name__, None, None, None))
    tables = {"leaves": leaf_rows(spark, trained["leaves"]), **{n: trained[n] for n in ("cqr", "curves", "bounds", "importances") if n in trained}}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        notes.append((name, "table", spark.read.parquet(f"{path}/{name}").count(), None, None))
    spark.createDataFrame(notes, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> dict:
    """The bundle as ``write_bundle`` got it. Raises ``ValueError`` for one that is unfinished, of another version, or damaged."""
    try:
        notes = {r["part"]: r for r in spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()}
    except Exception as missing:
        raise ValueError(f"{path} holds no finished bundle") from missing
    if "version" not in notes or notes["version"]["number"] != VERSION:
        raise ValueError(f"{path} is no bundle of version {VERSION}")
    found = {}
    for name, note in notes.items():
        try:
            if note["kind"] == "table":
                found[name] = spark.read.parquet(f"{path}/{name}")
            elif note["kind"] in KINDS:
                found[name] = KINDS[note["kind"]].load(f"{path}/{name}")
        except Exception as broken:
            raise ValueError(f"part {name} of the bundle in {path} cannot be read") from broken
        if note["kind"] == "table" and found[name].count() != note["n_rows"]:
            raise ValueError(f"part {name} of the bundle in {path} lacks rows")
    rows = found["leaves"].collect()
    table = np.zeros((max(r["tree"] for r in rows) + 1, max(r["leaf_id"] for r in rows) + 1, len(rows[0]["q"])))
    for r in rows:
        table[r["tree"], r["leaf_id"]] = r["q"]
    out = {"encoder": found["encoder"], "forest": found["forest"], "leaves": table, **{n: found[n] for n in ("cqr", "curves", "bounds", "importances") if n in found}}
    if "winner" in notes:
        models = {"tweedie": (found["tweedie"], notes["tweedie_unit"]["number"]), "boosted": found["boosted"],
                  "hurdle": (found["hurdle_share"], found["hurdle_size"], notes["hurdle_unit"]["number"])}
        out["point"] = {"basis": found["basis"], "models": models, "winner": notes["winner"]["name"], "power": notes["power"]["number"]}
    return out
