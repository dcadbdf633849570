"""The driver's tables read as campaign data."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ad_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as canonical campaign rows; ``row_order`` is the position that decides ``first``."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    sold = qty >= 25
    # 5% of the price in whole cents, halves up.
    cents = F.floor(price * 5 + 0.5)
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.when(flag == "A", "search_net").when(flag == "N", "social_net").otherwise("partner_net").alias("channel"),
        F.concat(flag, F.lit("::"), status, F.lit("-"), F.col("p_brand")).alias("campaign_id"),
        F.concat_ws(" ", "p_brand", "l_linestatus").alias("campaign_name"),
        F.to_date("l_shipdate").alias("date"),
        (price * F.col("l_tax")).alias("spend"),
        F.when(sold, price * (1 - F.col("l_discount"))).otherwise(0.0).alias("revenue"),
        F.when(sold, 1.0).otherwise(0.0).alias("conversions"),
        qty.alias("clicks"),
        (qty * 20 + F.col("p_size")).alias("impressions"),
        F.when(flag == "N", qty * 8).alias("reach"),
        F.when(flag == "A", qty * 3).alias("video_views"),
        status.alias("campaign_type"),
        F.when(flag != "R", cents / 100).alias("daily_budget"),
        # Order line position; the budget's cents settle lines that share a position.
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + cents).alias("row_order"),
    )


def order_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by market segment and priority: the second campaign view."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("c_mktsegment").alias("channel"),
        F.col("o_orderstatus").alias("campaign_type"),
        F.concat_ws("::", "c_mktsegment", "o_orderpriority").alias("campaign_id"),
        F.col("o_orderpriority").alias("campaign_name"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("revenue"),
        (F.col("o_totalprice") * 0.1).alias("spend"),
    )
