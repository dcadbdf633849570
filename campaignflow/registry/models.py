"""Model queries: Tweedie sweep, candidates, quantile forest, predictions, sweep and drivers (rows-only checks)."""

from pyspark.sql import functions as F

from campaignflow.operators import calibration as C
from campaignflow.operators import models as D
from campaignflow.operators.daily import day_sums, group_day
from campaignflow.plans import inference as I
from campaignflow.plans import training as T
from campaignflow.registry.budget import MULTIPLIERS
from campaignflow.functions import metrics as M
from campaignflow.registry.base_sql import with_ctes
from campaignflow.registry.core import KEPT, iso, query, rnd, rounded, shared, sql_rnd
from campaignflow.registry.forecast import DAY, EXACT_REVENUE, SPLIT, WAPE_SQL
from campaignflow.schema import QUANTILE_COLUMNS
from campaignflow.sources.bundle import read_bundle, write_bundle
from campaignflow.sources.fixtures import ad_canonical
from campaignflow.sources.workdir import scratch


_TRAINED = {}
KEPT.append(_TRAINED)


@shared
def ad_days(spark, sf_dir):
    """Order lines added up by campaign, day and attributes: the models' queries read the lines once, and this several times."""
    return day_sums(ad_canonical(spark, sf_dir))


def trained_forest(spark, sf_dir):
    """Train once per application and data folder; the queries below only read the result. ``release`` forgets it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = Trained(T.train_forest(ad_days(spark, sf_dir)))
    return _TRAINED[key].parts


class Trained:
    """A trained forest that can be released like a persisted frame."""

    def __init__(self, parts):
        self.parts = parts

    def unpersist(self):
        self.parts["frame"].unpersist()


@shared
def regression_rows(spark, sf_dir):
    return T.with_basis(trained_forest(spark, sf_dir)["frame"])[1]


@query("tweedie_sweep")
def tweedie_sweep(spark, sf_dir):
    best, out = T.swept_power(regression_rows(spark, sf_dir))
    return out.select("power", "n_folds", rnd("deviance", 2).alias("deviance"), rnd("common_deviance", 2).alias("common_deviance"),
                      (F.col("power") == best).alias("chosen"))


@query("point_models")
def point_models(spark, sf_dir):
    scored, power = T.point_candidates(regression_rows(spark, sf_dir))
    scored = scored.persist()
    out = C.compare_candidates(scored, {c: c for c in T.POINT}, "tweedie")
    quality = D.hurdle_quality(scored) | {"power": power}
    return out.withColumns({k: F.lit(v) for k, v in quality.items()}).select(
        "winner", "power", *rounded(2, "tweedie", "hurdle", "boosted", "blend", "best_loss"), *rounded(4, "improvement", "auc", "gamma_deviance"))


#: Forest of the folds' queries.
FOLD_FOREST = {"trees": 4, "depth": 6, "least": 40, "share": "onethird", "sample": 0.6}


@query("quantile_forest")
def quantile_forest(spark, sf_dir):
    out = T.evaluate_forest(trained_forest(spark, sf_dir))
    return out.select("stage", "horizon_days", "n_rows", rnd("crps", 2).alias("crps"),
                      *rounded(4, "wape", "naive_wape", "coverage_90", "coverage_80", "coverage_50"))


@query("forest_settings")
def forest_settings(spark, sf_dir):
    """Median pinball loss of every setting in every fold, and the setting with the least mean."""
    losses, best = T.choose_settings(ad_days(spark, sf_dir), trees=4)
    described = [(i, *(str(s[k]) for k in ("trees", "depth", "least", "share", "sample")), s == best) for i, s in enumerate(D.SETTINGS)]
    names = spark.createDataFrame(described, "setting int, trees string, depth string, least string, share string, sample string, chosen boolean")
    return losses.join(names, "setting").select("fold", "setting", "trees", "depth", "least", "share", "sample", rnd("loss", 2).alias("loss"), "chosen")


@shared
def fold_forecasts(spark, sf_dir):
    # Nine forests: smaller ones than the forest in use, on all rows.
    return T.out_of_fold(ad_days(spark, sf_dir), settings=FOLD_FOREST)


@query("model_folds")
def model_folds(spark, sf_dir):
    out = T.fold_report(fold_forecasts(spark, sf_dir))
    return out.select("kind", "fold", "n_rows", rnd("crps", 2).alias("crps"), *rounded(4, "wape", "naive_wape", "coverage_90", "coverage_80"))


@query("model_validation")
def model_validation(spark, sf_dir):
    out = T.validation_report(fold_forecasts(spark, sf_dir))
    return out.select("kind", "n_folds", rnd("crps", 2).alias("crps"), *rounded(4, "wape", "naive_wape", "coverage_90", "coverage_80", "crps_gap"))


@query("fold_coverage", with_ctes(f"""
, f AS (SELECT *, {DAY} AS day FROM split WHERE split IN ('train', 'calibration')),
b AS (SELECT min(day)::DOUBLE AS lo, max(day)::DOUBLE AS hi FROM f),
w AS (SELECT f.*, fold, CASE WHEN day + horizon_days <= cutoff THEN 'train' WHEN day > cutoff THEN 'validation' END AS role
      FROM f, (SELECT fold, round(lo + (hi - lo) * frac, 6) AS cutoff FROM b, (VALUES (0, 0.5::DOUBLE), (1, 0.64::DOUBLE), (2, 0.78::DOUBLE), (3, 0.92::DOUBLE)) v(fold, frac))),
z AS (SELECT campaign_id, count(*) AS n, substr(md5(campaign_id), 1, 2) AS slice FROM f GROUP BY 1),
g AS (SELECT campaign_id, (row_number() OVER (ORDER BY n DESC, slice, campaign_id) - 1) % 10 AS place FROM z),
v AS (SELECT 'walk_forward' AS kind, fold, campaign_id, origin_date, horizon_days, target_revenue, prediction FROM w WHERE role = 'validation'
        AND fold IN (SELECT fold FROM w GROUP BY fold HAVING count(*) FILTER (role = 'train') >= 200 AND count(*) FILTER (role = 'validation') >= 50)
      UNION ALL SELECT 'grouped', CASE WHEN place < 5 THEN place ELSE 9 - place END, campaign_id, origin_date, horizon_days, target_revenue, prediction FROM f JOIN g USING (campaign_id)),
o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY kind, campaign_id, origin_date, horizon_days ORDER BY fold) = 1)
SELECT kind, CAST(fold AS INTEGER) AS fold, count(*) AS n_rows, {sql_rnd(EXACT_REVENUE, 2)} AS revenue, {sql_rnd(WAPE_SQL.format(p='prediction'), 6)} AS naive_wape FROM o GROUP BY ALL""".replace("\n, f AS", ", f AS", 1), *SPLIT))
def fold_coverage(spark, sf_dir):
    """Which rows the out-of-fold table holds, each from the first fold that validated it, with the pace forecast's error."""
    first = C.first_fold(fold_forecasts(spark, sf_dir), ("kind", *T.ROW))
    return first.groupBy("kind", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.expr(EXACT_REVENUE), 2).alias("revenue"), rnd(M.wape("target_revenue", M.naive_pace()), 6).alias("naive_wape"))


@query("forest_predictions")
def forest_predictions(spark, sf_dir):
    """Calibrated quantiles and the chosen point forecast of every campaign, from a bundle written and read back."""
    days = ad_days(spark, sf_dir)
    trained = trained_forest(spark, sf_dir)
    path = scratch(spark, "bundle")
    write_bundle({**trained, "point": T.train_point(trained)}, path)
    out = I.predictions(read_bundle(spark, path), days, group_day(days))
    return out.select("campaign_id", "horizon_days", iso("origin_date", "origin_day"), *rounded(2, *QUANTILE_COLUMNS, "q50_display", "point_forecast"),
                      rnd("roas_p50", 4).alias("roas_p50"), "plausibility_flag", "saturation_status")


@query("whatif_sweep")
def whatif_sweep(spark, sf_dir):
    days = ad_days(spark, sf_dir)
    out = I.whatif_sweep(trained_forest(spark, sf_dir), days, group_day(days), MULTIPLIERS)
    return out.select("scope", "multiplier", "n_flagged", *rounded(2, "spend", *QUANTILE_COLUMNS))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    trained = trained_forest(spark, sf_dir)
    return D.importance(spark, trained["forest"], D.input_names(trained["frame"])).select("rank", "feature", rnd("gain", 6).alias("gain"))


@query("driver_attributions")
def driver_attributions(spark, sf_dir):
    """Mean contribution of every input, categories and missing-value flags included, to the log of the Tweedie forecast."""
    out = T.driver_attributions(ad_days(spark, sf_dir))
    return out.select("horizon_days", "channel", "feature", "rank", "n_rows", *rounded(4, "mean_abs", "mean_signed"))
