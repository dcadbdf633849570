"""Forecast-accuracy measures. Each ``*_loss``/``*_deviance`` is a per-row column; the rest are aggregates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from campaignflow.functions.scalars import col, safe_ratio
from campaignflow.schema import QUANTILES


def pinball_loss(y, p, q: float) -> Column:
    d = col(y) - col(p)
    return F.greatest(q * d, (q - 1) * d)


def pinball(y, p, q: float) -> Column:
    return F.avg(pinball_loss(y, p, q))


def crps(y, columns, quantiles=QUANTILES) -> Column:
    """Discretised CRPS: twice the mean pinball loss over the quantile grid."""
    total = sum(pinball_loss(y, c, q) for c, q in zip(columns, quantiles))
    return 2 * F.avg(total / len(quantiles))


def wape(y, p) -> Column:
    return F.sum(F.abs(col(y) - col(p))) / F.nullif(F.sum(F.abs(col(y))), F.lit(0.0))


def smape(y, p) -> Column:
    """Symmetric error over the rows where either side is non-zero."""
    return F.avg(safe_ratio(2 * F.abs(col(y) - col(p)), F.abs(col(y)) + F.abs(col(p))))


def tweedie_deviance(y, mu, power: float) -> Column:
    """Mean Tweedie deviance for any power, with the Poisson (1) and gamma (2) limits."""
    m = F.greatest(col(mu), F.lit(1e-6))
    t = F.greatest(col(y), F.lit(0.0))
    if abs(power - 2) < 1e-9:
        return gamma_deviance(t, m)
    if abs(power - 1) < 1e-9:
        first = F.when(t > 0, t * F.ln(F.greatest(t, F.lit(1e-9)) / m)).otherwise(0.0)
        return 2 * F.avg(first - t + m)
    first = F.pow(t, F.lit(2 - power)) / ((1 - power) * (2 - power))
    return 2 * F.avg(first - t * F.pow(m, F.lit(1 - power)) / (1 - power) + F.pow(m, F.lit(2 - power)) / (2 - power))


def gamma_deviance(y, mu) -> Column:
    t = F.greatest(col(y), F.lit(1e-9))
    return 2 * F.avg(F.ln(col(mu) / t) + col(y) / col(mu) - 1)


def coverage(y, low, high) -> Column:
    return F.avg(col(y).between(col(low), col(high)).cast("double"))


def skill(wape_model, wape_baseline) -> Column:
    """Share of the baseline's error removed."""
    return 1 - safe_ratio(wape_model, wape_baseline)


def naive_pace(pace="revenue_roll_mean_28", horizon="horizon_days") -> Column:
    """Carry the trailing 28-day mean forward; no history forecasts 0."""
    return F.greatest(F.coalesce(col(pace), F.lit(0.0)) * col(horizon), F.lit(0.0))


def auc(scored, label: str, score: str) -> float:
    """Exact area under the ROC curve, ties shared equally; Spark ranks the scores by range partitioning."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = scored.select((F.col(label) > 0).cast("double").alias("label"), F.col(score).cast("double").alias("score"))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label",
                                              metricName="areaUnderROC", numBins=0)
    return evaluator.evaluate(rows)
