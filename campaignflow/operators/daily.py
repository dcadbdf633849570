"""Campaign-day aggregation and the dense per-campaign calendar."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignflow.functions.scalars import first_by
from campaignflow.schema import NULL_SUMMED, ZERO_SUMMED

ATTRIBUTES = ["campaign_name", "channel", "campaign_type"]


def campaign_day(canonical: DataFrame, order: str = "row_order") -> DataFrame:
    """One row per (campaign_id, date).

    Five activity columns sum to 0 when nothing was reported, ``reach`` and ``video_views`` stay NULL.
    Attributes take the first non-null value in ``order`` (a BIGINT).

    The heavy first step groups by the text attributes as well, which leaves only numeric buffers: it hashes
    and combines on the map side, so a campaign holding a third of the rows shrinks before the shuffle. The
    second step settles the attributes among the few combinations left per day.

    ``canonical`` may be the result of the first step, ``day_sums``, where a caller keeps that for several uses.
    """
    combined = canonical if "budget_o" in canonical.columns else day_sums(canonical, order)
    return combined.groupBy("campaign_id", "date").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ZERO_SUMMED],
        *[F.sum(c).alias(c) for c in NULL_SUMMED],
        *[first_by(c, "o").alias(c) for c in ATTRIBUTES],
        F.min_by("daily_budget", "budget_o").alias("daily_budget"),
    )


def day_sums(canonical: DataFrame, order: str = "row_order") -> DataFrame:
    """One row per (campaign_id, date) and combination of attributes: all that daily features, group days and the last date need."""
    return canonical.groupBy("campaign_id", "date", *ATTRIBUTES).agg(
        F.min(order).alias("o"),
        *[F.sum(c).alias(c) for c in [*ZERO_SUMMED, *NULL_SUMMED]],
        F.min(F.when(F.col("daily_budget").isNotNull(), F.col(order))).alias("budget_o"),
        F.min_by("daily_budget", F.when(F.col("daily_budget").isNotNull(), F.col(order))).alias("daily_budget"),
    )


def dense_calendar(daily: DataFrame) -> DataFrame:
    """Fill every campaign's calendar between its own first and last day.

    Each observed day expands to itself plus the gap days up to the next observed day, so one shuffle by
    campaign serves the fills, the expansion and all later feature windows. A campaign's partition holds
    at most one row per calendar day, whatever the size of the source.

    Gap days carry the attributes and budget forward; an activity column is 0 on them when the campaign
    ever reported it and NULL otherwise. Values missing on observed days stay missing.
    """
    by_campaign = W.partitionBy("campaign_id")
    ordered = by_campaign.orderBy("date")
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    # A fixed partition number keeps adaptive execution from merging these small partitions into a few tasks:
    # the expansion below multiplies the rows, and all feature windows run in the same stage.
    tasks = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    observed = daily.repartition(tasks, "campaign_id").select(
        "campaign_id",
        "date",
        F.coalesce(F.lead("date").over(ordered), F.date_add("date", 1)).alias("next_date"),
        *[F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.first(c, ignorenulls=True).over(whole)).alias(c)
          for c in ATTRIBUTES],
        F.last("daily_budget", ignorenulls=True).over(so_far).alias("daily_budget"),
        *ZERO_SUMMED,
        *NULL_SUMMED,
        *[F.max(F.col(c).isNotNull()).over(by_campaign).alias(f"{c}_reported") for c in NULL_SUMMED],
    )
    days = observed.withColumn(
        "day", F.explode(F.sequence("date", F.date_sub("next_date", 1)))
    )
    seen = F.col("day") == F.col("date")
    return days.select(
        "campaign_id",
        F.col("day").alias("date"),
        seen.cast("int").alias("was_observed"),
        *ATTRIBUTES,
        "daily_budget",
        *[F.when(seen, F.col(c)).otherwise(0.0).alias(c) for c in ZERO_SUMMED],
        *[F.when(seen, F.col(c)).when(F.col(f"{c}_reported"), 0.0).alias(c) for c in NULL_SUMMED],
    )


def group_day(canonical: DataFrame, keys=("channel", "campaign_type")) -> DataFrame:
    """Spend and revenue per group and day: the shared input of bounds, curves, segments and anomalies."""
    return canonical.groupBy(*keys, "date").agg(
        F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue")
    )
