"""Advisory checks on the canonical table; nothing is dropped."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_NULL = ["channel", "campaign_id", "date", "spend", "revenue", "campaign_type"]
NON_NEGATIVE = ["spend", "revenue", "conversions", "clicks", "impressions", "reach", "video_views", "daily_budget"]


def schema_violations(canonical: DataFrame) -> DataFrame:
    """Failures per rule, all rules in one pass; rules without failures are listed with 0."""
    rules = [("not_null", c, F.col(c).isNull()) for c in NOT_NULL]
    rules += [("non_negative", c, F.coalesce(F.col(c) < 0, F.lit(False))) for c in NON_NEGATIVE]
    counted = canonical.agg(*[F.count_if(bad).alias(f"r{i}") for i, (_, _, bad) in enumerate(rules)])
    cells = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("field"), F.col(f"r{i}").alias("n_failures"))
        for i, (rule, c, _) in enumerate(rules)])
    return counted.select(F.explode(cells).alias("c")).select("c.*")


def type_problems(canonical: DataFrame, expected) -> list[str]:
    """Columns absent or of another type than the canonical schema."""
    have = {f.name: f.dataType for f in canonical.schema.fields}
    return [f.name for f in expected.fields if have.get(f.name) != f.dataType]


def duplicate_days(canonical: DataFrame) -> DataFrame:
    """Campaign-days reported more than once and how many rows share them."""
    return canonical.groupBy("campaign_id", "date").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def inconsistent(canonical: DataFrame, attribute: str) -> DataFrame:
    """Campaigns that show more than one value of an attribute, with the values seen."""
    # Distinct pairs first: a campaign with very many rows then carries only its few values.
    pairs = canonical.select("campaign_id", attribute).where(F.col(attribute).isNotNull()).distinct()
    return pairs.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("n_values"), F.array_sort(F.collect_list(attribute)).alias("seen")).where("n_values > 1")


def run_summary(canonical: DataFrame) -> DataFrame:
    return canonical.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("campaign_id").alias("n_campaigns"),
        F.count_distinct("channel").alias("n_channels"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
