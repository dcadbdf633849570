"""Online conformal calibration: batch comparison, step log and the streaming run."""

from pyspark.sql import functions as F

from campaignflow.operators import conformal as N
from campaignflow.registry.core import query, rnd, rounded
from campaignflow.registry.forecast import scored
from campaignflow.sources.fixtures import table
from campaignflow.streaming import conformal_stream as S


def campaign_sequence(spark, sf_dir):
    """90% pace band and outcome per origin date, one series for each campaign and horizon."""
    rows = scored(spark, sf_dir)
    return rows.select(F.concat_ws("/", "campaign_id", "horizon_days").alias("series"), F.unix_date("origin_date").cast("long").alias("seq"),
                       F.col("q05").alias("low"), F.col("q95").alias("high"), F.col("target_revenue").alias("y"))


@query("adaptive_conformal")
def adaptive_conformal(spark, sf_dir):
    out = N.summarise_methods(N.compare_methods(campaign_sequence(spark, sf_dir)))
    return out.select("method", "n_series", "n_scored", rnd("coverage", 6).alias("coverage"), rnd("mean_width", 2).alias("mean_width"))


@query("conformal_steps")
def conformal_steps(spark, sf_dir):
    out = N.run_online(S.hourly_sequence(table(spark, sf_dir, "events")))
    return out.select("series", "seq", "method", *rounded(6, "level", "correction", "low", "high"), "covered")


@query("conformal_stream")
def conformal_stream(spark, sf_dir):
    out = S.replay(S.hourly_sequence(table(spark, sf_dir, "events")), "pid")
    return out.select("series", "seq", *rounded(6, "level", "correction", "low", "high"), "covered", "n_late")


@query("hourly_sequence", """
SELECT event_type AS series, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS seq, count(*) * 25.0::DOUBLE AS low,
       count(*) * 75.0::DOUBLE AS high, round(sum(value) + 2.718281828459045e-06::DOUBLE, 4) AS y FROM events GROUP BY ALL""")
def hourly_sequence(spark, sf_dir):
    return S.hourly_sequence(table(spark, sf_dir, "events")).withColumn("y", rnd("y"))
