"""Scope summaries: the total and every channel in one set-based plan."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignflow.functions.scalars import safe_ratio
from campaignflow.operators.insights import anomalies, period_over_period

TOTAL = "total"


def channel_saturation(live: DataFrame, curves: DataFrame) -> DataFrame:
    """Mean over the fitted types of mean planned budget over K, per channel."""
    per_type = live.groupBy("channel", "campaign_type").agg(F.avg("planned_future_daily_budget").alias("planned"))
    fitted = curves.where("fit_ok").select("channel", "campaign_type", "K")
    return per_type.join(fitted, ["channel", "campaign_type"]).groupBy("channel").agg(
        F.avg(F.col("planned") / F.col("K")).alias("fill"))


def scope_summaries(live: DataFrame, group_days: DataFrame, curves: DataFrame, horizon: int = 30, top: int = 5) -> DataFrame:
    """Forecast, ROAS, period over period, strongest anomalies and saturation, one row per scope.

    ``channel`` is NULL on the total row.
    """
    at = live.where(F.col("horizon_days") == horizon)
    kpi = at.rollup("channel").agg(
        *[F.sum(f"q{p}").alias(f"revenue_p{p}") for p in (10, 50, 90)],
        F.sum(F.col("planned_future_daily_budget") * F.col("horizon_days")).alias("spend"))
    keyed = kpi.withColumn("scope", F.coalesce("channel", F.lit(TOTAL)))

    change = period_over_period(group_days, ["channel"], horizon).withColumnRenamed("channel", "scope").unionByName(
        period_over_period(group_days, [], horizon).withColumn("scope", F.lit(TOTAL)))

    hits = anomalies(group_days, top=None)
    scoped = hits.withColumn("scope", F.explode(F.array("channel", F.lit(TOTAL))))
    order = W.partitionBy("scope").orderBy(F.abs("z_score").desc(), "channel", "campaign_type", "date")
    strongest = scoped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    listed = strongest.groupBy("scope").agg(
        F.sort_array(F.collect_list(F.struct("rank", "date", "channel", "campaign_type", "z_score"))).alias("anomalies"))

    fill = channel_saturation(at, curves).withColumnRenamed("channel", "scope")
    status = (
        F.when(F.col("scope") == TOTAL, "mixed_across_channels")
        .when(F.col("fill") > 1.5, "near_saturation")
        .when(F.col("fill") > 0.5, "approaching_saturation")
        .when(F.col("fill").isNotNull(), "room_to_grow")
        .otherwise("unknown_insufficient_data")
    )
    return (
        keyed.join(change.select("scope", "revenue_delta_pct", "spend_delta_pct"), "scope", "left")
        .join(listed, "scope", "left")
        .join(fill, "scope", "left")
        .select("channel", F.lit(horizon).alias("window_days"), "revenue_p10", "revenue_p50", "revenue_p90", "spend",
                safe_ratio("revenue_p50", "spend").alias("roas_p50"), "revenue_delta_pct", "spend_delta_pct",
                F.coalesce("anomalies", F.array().cast(listed.schema["anomalies"].dataType)).alias("anomalies"),
                status.alias("saturation_status"))
    )


def grounding_context():
    """The numbers a text about a scope may quote, as JSON in plain decimal notation.

    Deltas are listed by magnitude because sentences put the direction in words.
    """
    def plain(c, digits=2):
        return F.col(c).cast(f"decimal(38,{digits})").alias(c)

    return F.to_json(F.struct(
        F.struct("channel", "window_days", F.lit(80).alias("band_percent")).alias("scope"),
        F.struct(plain("revenue_p10"), plain("revenue_p50"), plain("revenue_p90"), plain("roas_p50", 4)).alias("forecast"),
        F.struct(F.abs("revenue_delta_pct").alias("revenue_delta_pct"), F.abs("spend_delta_pct").alias("spend_delta_pct"))
        .alias("period_over_period"),
        "anomalies", "saturation_status"))
