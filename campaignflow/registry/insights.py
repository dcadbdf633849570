"""Leaders, dominant status, recommendations, scope summaries, grounding and narration."""

from pyspark.sql import functions as F

from campaignflow.functions.scalars import safe_ratio
from campaignflow.operators import insights as I
from campaignflow.plans.summaries import grounding_context, scope_summaries
from campaignflow.registry.base_sql import CTES, with_ctes
from campaignflow.registry.budget import CURVES, SATURATED, curves, saturated
from campaignflow.registry.core import query, rnd, rounded, sql_rnd, sql_rounded
from campaignflow.registry.features import SCORING
from campaignflow.registry.forecast import live_scoring, pace_quantiles
from campaignflow.registry.groups import group_days, pop_sql
from campaignflow.sources.fixtures import table


@query("top_bottom_campaigns", with_ctes(f"""
(SELECT 'leader' AS list, campaign_id, {sql_rnd('naive_revenue')} AS revenue FROM scoring WHERE horizon_days = 30 ORDER BY naive_revenue DESC, campaign_id LIMIT 5)
UNION ALL (SELECT 'laggard', campaign_id, {sql_rnd('naive_revenue')} FROM scoring WHERE horizon_days = 30 AND naive_revenue > 0 ORDER BY naive_revenue, campaign_id LIMIT 5)""", *SCORING))
def top_bottom_campaigns(spark, sf_dir):
    live = live_scoring(spark, sf_dir).where("horizon_days = 30").select("campaign_id", "naive_revenue")
    return I.leaders(live, "naive_revenue").select("list", "campaign_id", rnd("naive_revenue").alias("revenue"))


CTES["dominant"] = """
SELECT channel, horizon_days, arg_min(saturation_status, struct_pack(n := -n, s := saturation_status)) AS status
FROM (SELECT channel, horizon_days, saturation_status, count(*) AS n FROM saturated GROUP BY ALL) GROUP BY channel, horizon_days"""


@query("dominant_status", with_ctes("SELECT channel, horizon_days, status FROM dominant", *SATURATED, "dominant"))
def dominant_status(spark, sf_dir):
    d = I.dominant_category(saturated(spark, sf_dir), ["channel", "horizon_days"], "saturation_status")
    return d.withColumnRenamed("dominant_saturation_status", "status")


CTES["channel_kpi"] = """
SELECT channel, horizon_days, sum(naive_revenue) AS revenue, sum(assumed_spend_total) AS spend,
       sum(naive_revenue) / nullif(sum(assumed_spend_total), 0) AS roas,
       sum(sum(naive_revenue)) OVER h / nullif(sum(sum(assumed_spend_total)) OVER h, 0) AS blended,
       sum(naive_revenue) / nullif(sum(sum(naive_revenue)) OVER h, 0) AS share
FROM scoring GROUP BY channel, horizon_days WINDOW h AS (PARTITION BY horizon_days)"""


@query("recommendations", with_ctes(f"""
SELECT k.channel, k.horizon_days, {sql_rnd('roas', 6)} AS roas, {sql_rnd('blended', 6)} AS blended, {sql_rnd('share', 6)} AS share,
       CASE WHEN status = 'room_to_grow' AND roas > blended THEN 'scale' WHEN status = 'near_saturation' THEN 'diminishing'
            WHEN status = 'approaching_saturation' THEN 'approaching' ELSE 'stable' END AS recommendation
FROM channel_kpi k JOIN dominant d ON d.channel = k.channel AND d.horizon_days = k.horizon_days""", *SATURATED, "dominant", "channel_kpi"))
def recommendations(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = saturated(spark, sf_dir)
    scope = W.partitionBy("horizon_days")
    kpi = rows.groupBy("channel", "horizon_days").agg(F.sum("naive_revenue").alias("revenue"), F.sum("assumed_spend_total").alias("spend"))
    kpi = kpi.withColumns({
        "roas": safe_ratio("revenue", "spend"),
        "blended": F.sum("revenue").over(scope) / F.nullif(F.sum("spend").over(scope), F.lit(0.0)),
        "share": F.col("revenue") / F.nullif(F.sum("revenue").over(scope), F.lit(0.0))})
    status = I.dominant_category(rows, ["channel", "horizon_days"], "saturation_status")
    joined = kpi.join(status, ["channel", "horizon_days"])
    return joined.select("channel", "horizon_days", *rounded(6, "roas", "blended", "share"),
                         I.channel_recommendation("dominant_saturation_status", "roas", "blended").alias("recommendation"))


@query("trend_class", with_ctes(f"""
SELECT channel, CASE WHEN r IS NULL OR s IS NULL THEN 'unknown' WHEN r >= 0 AND s <= 0 THEN 'efficiency_improving' WHEN r >= 0 AND r / s > 1.5 THEN 'strong_growth'
  WHEN r >= 0 THEN 'growth_with_caution' ELSE 'under_pressure' END AS trend_class
FROM (SELECT channel, revenue_delta AS r, spend_delta AS s FROM ({pop_sql('group_day', 'channel')}))""", "canonical", "group_day"))
def trend_class(spark, sf_dir):
    p = I.period_over_period(group_days(spark, sf_dir), ["channel"])
    return p.select("channel", I.trend_class("revenue_delta_pct", "spend_delta_pct").alias("trend_class"))


CTES["channel_fill"] = """
SELECT channel, horizon_days, avg(r) AS fill FROM (
  SELECT channel, horizon_days, campaign_type, avg(planned_future_daily_budget) / any_value(kk) AS r FROM saturated WHERE fit_ok GROUP BY ALL) GROUP BY ALL"""


@query("scope_summary", with_ctes(f"""
, k AS (SELECT coalesce(channel, 'total') AS scope, sum(naive_revenue) AS p50, sum(assumed_spend_total) AS spend FROM scoring WHERE horizon_days = 30
       GROUP BY GROUPING SETS ((), (channel))),
f AS (SELECT channel, fill FROM channel_fill WHERE horizon_days = 30)
SELECT scope, {sql_rnd('p50 * 0.5')} AS revenue_p10, {sql_rnd('p50')} AS revenue_p50, {sql_rnd('p50 * 1.8')} AS revenue_p90, {sql_rnd('p50 / nullif(spend, 0)', 6)} AS roas_p50,
  CASE WHEN scope = 'total' THEN 'mixed_across_channels' WHEN fill > 1.5 THEN 'near_saturation' WHEN fill > 0.5 THEN 'approaching_saturation'
       WHEN fill IS NOT NULL THEN 'room_to_grow' ELSE 'unknown_insufficient_data' END AS saturation_status
FROM k LEFT JOIN f ON f.channel = k.scope""".replace("\n, k AS", ", k AS", 1), *SATURATED, "channel_fill"))
def scope_summary(spark, sf_dir):
    return summaries(spark, sf_dir).select(
        F.coalesce("channel", F.lit("total")).alias("scope"), *rounded(4, "revenue_p10", "revenue_p50", "revenue_p90"),
        rnd("roas_p50", 6).alias("roas_p50"), "saturation_status")


def summaries(spark, sf_dir):
    live = pace_quantiles(live_scoring(spark, sf_dir))
    return scope_summaries(live, group_days(spark, sf_dir), curves(spark, sf_dir), horizon=30)


@query("narrative")
def narrative(spark, sf_dir):
    told = I.narrative(summaries(spark, sf_dir))
    return told.select(F.coalesce("channel", F.lit("total")).alias("scope"), "summary", "risk_flags",
                       grounding_context().alias("context"))


@query("narrative_is_grounded")
def narrative_is_grounded(spark, sf_dir):
    told = I.narrative(summaries(spark, sf_dir))
    rows = told.select(F.coalesce("channel", F.lit("total")).alias("scope"),
                       F.concat_ws(" ", "summary", "risk_flags").alias("text"), grounding_context().alias("context"))
    return I.grounding_verdict(rows, rows, "scope")


NUMBER_SQL = r"""
SELECT doc_id, list_distinct(list_filter(list_transform(
  regexp_extract_all(regexp_replace({text}, '([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})', '\1 \2 \3', 'g'), '-?[0-9][0-9,]*\.?[0-9]*'),
  lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)) AS nums FROM {source}"""
CTES["claims"] = "SELECT doc_id, unnest(nums) AS number FROM (" + NUMBER_SQL.format(text="text", source="documents") + ")"
CTES["contexts"] = """SELECT d.doc_id, a FROM documents d, (SELECT lang, count(*) AS c, sum(n_chars) AS s, max(n_chars) AS m FROM documents GROUP BY lang) l,
  LATERAL (SELECT unnest([d.doc_id, d.n_chars, l.c, l.s, l.m, 2024]) AS a) WHERE l.lang = d.lang"""


def grounding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    by_lang = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("c"), F.sum("n_chars").alias("s"), F.max("n_chars").alias("m"))
    contexts = docs.select("doc_id", "n_chars", "lang").join(by_lang, "lang").select(
        "doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "n_chars", "c", "s", "m", F.lit(2024).alias("year"))).alias("context"))
    return docs.select("doc_id", "text"), contexts


@query("grounding_check", with_ctes("""
, j AS (SELECT c.doc_id, c.number FROM claims c WHERE NOT EXISTS (
   SELECT 1 FROM contexts x WHERE x.doc_id = c.doc_id AND abs(c.number - x.a) <= greatest(0.02::DOUBLE * abs(x.a), 0.5::DOUBLE)))
SELECT d.doc_id, coalesce(n.n, 0) AS n_claimed, coalesce(b.n, 0) AS n_unsupported, b.smallest AS smallest_unsupported, b.n IS NULL AS grounded
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM claims GROUP BY doc_id) n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n, min(number) AS smallest FROM j GROUP BY doc_id) b ON b.doc_id = d.doc_id""".replace("\n, j AS", ", j AS", 1), "claims", "contexts"))
def grounding_check(spark, sf_dir):
    texts, contexts = grounding(spark, sf_dir)
    return I.grounding_verdict(texts, contexts, "doc_id").withColumn("n_claimed", F.col("n_claimed").cast("long"))


@query("unsupported_numbers", with_ctes("""
SELECT c.doc_id, c.number FROM claims c WHERE NOT EXISTS (
   SELECT 1 FROM contexts x WHERE x.doc_id = c.doc_id AND abs(c.number - x.a) <= greatest(0.02::DOUBLE * abs(x.a), 0.5::DOUBLE))""", "claims", "contexts"))
def unsupported_numbers(spark, sf_dir):
    texts, contexts = grounding(spark, sf_dir)
    return I.unsupported_numbers(texts, contexts, "doc_id")
