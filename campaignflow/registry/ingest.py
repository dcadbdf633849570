"""Column mapping, value cleaning, canonical projection, ingestion report and validation."""

from pyspark.sql import functions as F

from campaignflow.operators import canonical as C
from campaignflow.operators import mapping as M
from campaignflow.operators import validation as V
from campaignflow.registry.base_sql import CTES, with_ctes
from campaignflow.registry.core import iso, query, rnd, rounded, sql_iso, sql_rnd, sql_rounded
from campaignflow.schema import ALIASES, CHANNEL_GLOBS, TYPE_PATTERNS
from campaignflow.sources.files import ingest_directory
from campaignflow.sources.fixtures import ad_canonical, table
from campaignflow.sources.workdir import scratch

# Header words for catalogues derived from the order lines: true aliases, near misses and junk.
HEADERS = ["CampaignId", "Camp_Nm", "TimePeriod", "Cost_Local", "Ad_Spend_USD", "Revenue", "Conv Count", "Clicks", "cpc", "ctr",
           "Impressions", "Reach", "VideoViews", "Ad_Type", "DailyBudget", "platform", "date", "campaign id", "some_new_field_2026"]
SQL_LIST = "[" + ", ".join(f"'{h}'" for h in HEADERS) + "]"


def header_catalogue(spark, sf_dir):
    """One file per supplier, its columns picked by the parts it ships."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.pmod("l_partkey", F.lit(len(HEADERS))).alias("h")).distinct()
    words = F.array(*[F.lit(h) for h in HEADERS])
    return lines.select(F.concat(F.lit("export_"), F.col("l_suppkey").cast("string"), F.lit(".csv")).alias("source"),
                        F.col("h").cast("int").alias("pos"), words[F.col("h").cast("int")].alias("raw_col"))


CTES["catalogue"] = f"""
SELECT DISTINCT 'export_' || l_suppkey || '.csv' AS source, CAST(l_partkey % {len(HEADERS)} AS INTEGER) AS pos,
       {SQL_LIST}[l_partkey % {len(HEADERS)} + 1] AS raw_col FROM lineitem"""
CTES["aliases"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{f}')" for a, f in {M.plain(a): f for f, al in ALIASES.items() for a in al}.items()) + ") v(norm, field)"


@query("exact_alias_map", with_ctes("""
SELECT c.source, c.pos, c.raw_col, CASE WHEN a.field IS NOT NULL AND row_number() OVER (PARTITION BY c.source, a.field ORDER BY c.pos) = 1 THEN a.field END AS field
FROM catalogue c LEFT JOIN aliases a ON a.norm = regexp_replace(lower(c.raw_col), '[^a-z0-9]', '', 'g')""", "catalogue", "aliases"))
def exact_alias_map(spark, sf_dir):
    return M.exact_mapping(header_catalogue(spark, sf_dir))


@query("fuzzy_column_map")
def fuzzy_column_map(spark, sf_dir):
    return M.map_columns(header_catalogue(spark, sf_dir))


def dirty_lines(spark, sf_dir):
    """Order lines with their price written in six vendor styles."""
    lines = table(spark, sf_dir, "lineitem")
    price = F.format_number("l_extendedprice", 2)
    style = F.pmod("l_partkey", F.lit(7))
    text = (F.when(style == 0, F.concat(F.lit("$"), price)).when(style == 1, F.concat(F.lit("("), price, F.lit(")")))
            .when(style == 2, F.concat(price, F.lit("%"))).when(style == 3, "").when(style == 4, F.concat(F.lit(" €"), price, F.lit(" ")))
            .when(style == 5, "n/a").otherwise(price))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    date = (F.when(style == 0, day).when(style == 1, F.date_format("l_shipdate", "M/d/yyyy"))
            .when(style == 2, F.concat(day, F.lit(" 10:15:00"))).when(style == 3, "not a date").otherwise(F.date_format("l_shipdate", "yyyy/M/d")))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag",
                        "l_linestatus", text.alias("amount"), date.alias("day_text"), F.lit("").alias("blank"))


CTES["dirty"] = """
SELECT *, CASE l_partkey % 7 WHEN 0 THEN '$' || p WHEN 1 THEN '(' || p || ')' WHEN 2 THEN p || '%' WHEN 3 THEN '' WHEN 4 THEN ' €' || p || ' '
            WHEN 5 THEN 'n/a' ELSE p END AS amount,
       CASE l_partkey % 7 WHEN 0 THEN d WHEN 1 THEN month(l_shipdate) || '/' || day(l_shipdate) || '/' || year(l_shipdate)
            WHEN 2 THEN d || ' 10:15:00' WHEN 3 THEN 'not a date' ELSE year(l_shipdate) || '/' || month(l_shipdate) || '/' || day(l_shipdate) END AS day_text
FROM (SELECT *, format('{:,.2f}', l_extendedprice) AS p, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem)"""
CLEAN = r"TRY_CAST(regexp_replace(regexp_replace(regexp_replace(trim(amount), '^\((.*)\)$', '\1'), '%$', ''), '[,$€£₹\s]', '', 'g') AS DOUBLE)"
CTES["cleaned"] = rf"""
SELECT *, CASE WHEN regexp_matches(trim(amount), '^\(.*\)$') THEN -abs({CLEAN}) ELSE {CLEAN} END AS value FROM dirty"""


@query("numeric_clean", with_ctes(
    f"SELECT l_orderkey, l_linenumber, l_partkey, amount, {sql_rnd('value')} AS value FROM cleaned", "dirty", "cleaned"))
def numeric_clean(spark, sf_dir):
    return dirty_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "amount", rnd(C.clean_number("amount")).alias("value"))


@query("parse_report", with_ctes("""
SELECT 'spend' AS field, count(*) AS n_total, count(*) FILTER (trim(amount) <> '') AS n_nonempty, count(*) FILTER (trim(amount) <> '' AND value IS NULL) AS n_failed,
       min(trim(amount)) FILTER (trim(amount) <> '' AND value IS NULL) AS example,
       count(*) FILTER (trim(amount) <> '' AND value IS NULL) > 0.02 * count(*) FILTER (trim(amount) <> '') AS warn_unparsed, false AS warn_all_blank FROM cleaned
UNION ALL SELECT 'clicks', count(*), 0, 0, NULL, false, true FROM cleaned""", "dirty", "cleaned"))
def parse_report(spark, sf_dir):
    return C.parse_report(dirty_lines(spark, sf_dir), {"spend": "amount", "clicks": "blank"})


@query("date_parse_report", with_ctes(f"""
SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (l_partkey % 7 = 3) AS n_unparsed,
       {sql_iso('min(CAST(l_shipdate AS DATE)) FILTER (l_partkey % 7 <> 3)', 'first_day')}, {sql_iso('max(CAST(l_shipdate AS DATE)) FILTER (l_partkey % 7 <> 3)', 'last_day')},
       CAST(sum(CASE WHEN l_partkey % 7 <> 3 THEN date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) END) AS BIGINT) AS day_sum
FROM dirty GROUP BY l_returnflag""", "dirty"))
def date_parse_report(spark, sf_dir):
    d = dirty_lines(spark, sf_dir).withColumn("day", C.parse_date("day_text"))
    return d.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("day").isNull()).alias("n_unparsed"), iso(F.min("day"), "first_day"),
        iso(F.max("day"), "last_day"), F.sum(F.unix_date("day")).alias("day_sum"))


WORDS = ["Prospecting", "Retargeting", "Brand", "Shopping", "Search", "PMax", "Performance Max", "Display", "Video", "Demand-Gen", "Audience", "Misc"]
CTES["named"] = f"SELECT p_partkey, [{', '.join(repr(w) for w in WORDS)}][p_partkey % {len(WORDS)} + 1] || ' ' || p_name AS name FROM part"


@query("type_inference", with_ctes(
    "SELECT p_partkey, name, CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{t}'" for p, t in TYPE_PATTERNS)
    + " ELSE 'unclassified' END AS campaign_type FROM named", "named"))
def type_inference(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in WORDS])
    name = F.concat_ws(" ", words[F.pmod("p_partkey", F.lit(len(WORDS))).cast("int")], "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("campaign_type", C.infer_type("name"))


FILES = ["google_ads_campaign", "GAds-export", "ga_", "Meta_Ads", "fb_", "my_facebook_ads", "bing", "msads", "microsoft ads", "tiktok", "x_gads_campaign"]
CTES["file_names"] = f"SELECT p_partkey, [{', '.join(repr(w) for w in FILES)}][p_partkey % {len(FILES)} + 1] || p_partkey || '.csv' AS name FROM part"


@query("channel_from_file", with_ctes(
    "SELECT p_partkey, name, CASE " + " ".join(
        f"WHEN regexp_matches(lower(name), '{'|'.join(C.glob_pattern(g) for g in globs)}') THEN '{ch}'" for ch, globs in CHANNEL_GLOBS)
    + " END AS channel FROM file_names", "file_names"))
def channel_from_file(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in FILES])
    name = F.concat(words[F.pmod("p_partkey", F.lit(len(FILES))).cast("int")], F.col("p_partkey").cast("string"), F.lit(".csv"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("channel", C.channel_of_file("name"))


# The three vendor layouts: raw column per canonical field, as their exports name them.
LAYOUTS = {
    "google": {"campaign_id": "campaign_id", "campaign_name": "campaign_name", "segments_date": "date", "metrics_cost_micros": "spend",
               "metrics_conversions_value": "revenue", "metrics_clicks": "clicks", "metrics_video_views": "video_views",
               "campaign_advertising_channel_type": "campaign_type"},
    "meta": {"campaign_id": "campaign_id", "campaign_name": "campaign_name", "date_start": "date", "spend": "spend",
             "conversion": "conversions", "reach": "reach", "clicks": "clicks"},
    "bing": {"CampaignId": "campaign_id", "TimePeriod": "date", "Spend": "spend", "Revenue": "revenue", "Clicks": "clicks",
             "CampaignType": "campaign_type", "DailyBudget": "daily_budget"},
}


def vendor_frame(spark, sf_dir, flag, layout):
    """Order lines of one flag as a vendor export: all text, vendor column names."""
    lines = dirty_lines(spark, sf_dir).where(F.col("l_returnflag") == flag)
    micros = F.col("l_extendedprice").cast("decimal(18,2)") * 1000000
    values = {
        "campaign_id": F.col("l_suppkey").cast("string"), "campaign_name": F.concat(F.lit("brand "), F.col("l_suppkey").cast("string")),
        "date": F.col("day_text"), "spend": F.when(F.lit(layout == "google"), micros.cast("string")).otherwise(F.col("amount")),
        "revenue": F.col("amount"), "conversions": F.col("amount"), "clicks": F.col("l_quantity").cast("int").cast("string"),
        "reach": F.lit(""), "video_views": F.col("l_quantity").cast("int").cast("string"),
        "campaign_type": F.when(F.col("l_linestatus") == "F", "nan").otherwise(F.col("l_linestatus")), "daily_budget": F.col("amount")}
    return lines.select(*[values[f].alias(raw) for raw, f in LAYOUTS[layout].items()])


def vendor_canonical(spark, sf_dir):
    out = None
    for flag, layout in (("A", "google"), ("N", "meta"), ("R", "bing")):
        part = C.to_canonical(vendor_frame(spark, sf_dir, flag, layout), LAYOUTS[layout], f"{layout}.csv", layout)
        out = part if out is None else out.unionByName(part)
    return out


CTES["vendor"] = """
SELECT v.channel, v.channel || '::' || l_suppkey AS campaign_id, CAST(l_shipdate AS DATE) AS date,
       CASE l_returnflag WHEN 'A' THEN l_extendedprice ELSE greatest(coalesce(value, 0), 0) END AS spend, greatest(coalesce(value, 0), 0) AS revenue,
       CASE WHEN l_returnflag = 'N' THEN coalesce(value, 0) END AS conversions, l_quantity AS clicks, NULL::DOUBLE AS impressions,
       CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE END AS reach, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS video_views,
       CASE WHEN l_returnflag = 'N' THEN 'brand' WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'A' THEN 'brand' ELSE 'unclassified' END ELSE l_linestatus END AS campaign_type,
       CASE WHEN l_returnflag = 'R' THEN value END AS daily_budget
FROM cleaned JOIN (VALUES ('A', 'google'), ('N', 'meta'), ('R', 'bing')) v(flag, channel) ON flag = l_returnflag WHERE l_partkey % 7 <> 3"""
VENDOR = ("dirty", "cleaned", "vendor")


@query("canonical_projection", with_ctes(f"""
SELECT channel, campaign_id, {sql_iso('date', 'day')}, campaign_type, count(*) AS n_rows, {', '.join(f'{sql_rnd(f"sum({c})")} AS {c}' for c in
    ('spend', 'revenue', 'conversions', 'clicks', 'impressions', 'reach', 'video_views', 'daily_budget'))} FROM vendor GROUP BY ALL""", *VENDOR))
def canonical_projection(spark, sf_dir):
    v = vendor_canonical(spark, sf_dir)
    return v.groupBy("channel", "campaign_id", iso("date", "day"), "campaign_type").agg(
        F.count(F.lit(1)).alias("n_rows"), *[rnd(F.sum(c)).alias(c) for c in
        ("spend", "revenue", "conversions", "clicks", "impressions", "reach", "video_views", "daily_budget")])


@query("schema_report", with_ctes(f"""
SELECT channel, count(*) AS n_rows, count(DISTINCT campaign_id) AS n_campaigns, {sql_iso('min(date)', 'first_day')}, {sql_iso('max(date)', 'last_day')},
       count(*) FILTER (campaign_type = 'unclassified') AS n_unclassified, count(*) FILTER (daily_budget IS NULL) AS null_daily_budget,
       count(*) FILTER (conversions IS NULL) AS null_conversions, count(*) FILTER (reach IS NULL) AS null_reach FROM vendor GROUP BY channel""", *VENDOR))
def schema_report(spark, sf_dir):
    r = C.ingestion_report(vendor_canonical(spark, sf_dir))
    return r.select("channel", "n_rows", "n_campaigns", iso("first_date", "first_day"), iso("last_date", "last_day"), "n_unclassified",
                    "null_daily_budget", "null_conversions", "null_reach")


def ingested_exports(spark, sf_dir):
    """The three vendor exports written as CSV files, with blank ids and line breaks in quoted cells, and read back by ``ingest_directory``."""
    path = scratch(spark, "exports")
    for flag, layout in (("A", "google"), ("N", "meta"), ("R", "bing")):
        ident = next(c for c, f in LAYOUTS[layout].items() if f == "campaign_id")
        frame = vendor_frame(spark, sf_dir, flag, layout).withColumns({
            ident: F.when(F.col(ident).endswith("3"), "").otherwise(F.col(ident)), "channel": F.lit(layout.upper()),
            "notes": F.concat(F.lit('first line, "'), F.col(ident), F.lit('"\n\nlast "line'))})
        # A campaign stays in one file, so that campaigns counted per file add up.
        frame.repartition(ident).write.options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{layout}")
    return ingest_directory(spark, f"{path}/*")


CTES["exported"] = """
SELECT c.*, v.channel, l_partkey % 7 <> 3 AS dated, CASE WHEN l_suppkey % 10 = 3 THEN 'nan' ELSE CAST(l_suppkey AS VARCHAR) END AS ident,
       CASE WHEN l_returnflag = 'N' THEN 'brand' WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'A' THEN 'brand' ELSE 'unclassified' END ELSE l_linestatus END AS campaign_type
FROM cleaned c JOIN (VALUES ('A', 'google'), ('N', 'meta'), ('R', 'bing')) v(flag, channel) ON flag = l_returnflag"""
EXPORTED = ("dirty", "cleaned", "exported")


@query("csv_ingest", with_ctes(f"""
SELECT channel, channel || '::' || ident AS campaign_id, {sql_iso('CAST(l_shipdate AS DATE)', 'day')}, campaign_type, count(*) AS n_rows,
       {sql_rnd("sum(CASE l_returnflag WHEN 'A' THEN l_extendedprice ELSE greatest(coalesce(value, 0), 0) END)")} AS spend,
       {sql_rnd('sum(greatest(coalesce(value, 0), 0))')} AS revenue, {sql_rnd('sum(l_quantity)')} AS clicks
FROM exported WHERE dated GROUP BY ALL""", *EXPORTED))
def csv_ingest(spark, sf_dir):
    data, _ = ingested_exports(spark, sf_dir)
    return data.groupBy("channel", "campaign_id", iso("date", "day"), "campaign_type").agg(
        F.count(F.lit(1)).alias("n_rows"), *[rnd(F.sum(c)).alias(c) for c in ("spend", "revenue", "clicks")])


@query("csv_report", with_ctes(f"""
SELECT channel, count(*) FILTER (dated) AS n_rows, count(*) FILTER (NOT dated) AS n_dropped, count(DISTINCT ident) FILTER (dated) AS n_campaigns,
       {sql_iso('min(CAST(l_shipdate AS DATE)) FILTER (dated)', 'first_day')}, {sql_iso('max(CAST(l_shipdate AS DATE)) FILTER (dated)', 'last_day')},
       count(*) FILTER (ident = 'nan') AS n_blank_ids, count(*) FILTER (dated AND campaign_type = 'unclassified') AS n_unclassified,
       count(*) FILTER (channel = 'google' OR trim(amount) <> '') AS spend_cells, count(*) FILTER (channel <> 'google' AND trim(amount) <> '' AND value IS NULL) AS spend_failed
FROM exported GROUP BY channel""", *EXPORTED))
def csv_report(spark, sf_dir):
    _, report = ingested_exports(spark, sf_dir)
    spend = F.filter("parsed", lambda p: p["field"] == "spend")[0]
    return report.where("error IS NULL").groupBy("channel").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_dropped", "n_campaigns")], iso(F.min("first_date"), "first_day"), iso(F.max("last_date"), "last_day"),
        F.sum("n_blank_ids").alias("n_blank_ids"), F.sum("n_unclassified").alias("n_unclassified"),
        F.sum(spend["n_nonempty"]).alias("spend_cells"), F.sum(spend["n_failed"]).alias("spend_failed"))


@query("schema_violations", with_ctes("""
SELECT * FROM (""" + " UNION ALL ".join(
    [f"SELECT 'not_null' AS rule, '{c}' AS field, count(*) FILTER ({c} IS NULL) AS n_failures FROM v" for c in V.NOT_NULL]
    + [f"SELECT 'non_negative', '{c}', count(*) FILTER ({c} < 0) FROM v" for c in V.NON_NEGATIVE]) + ")", *VENDOR).replace("\nSELECT * FROM (SELECT", ", v AS (SELECT * FROM vendor)\nSELECT * FROM (SELECT", 1))
def schema_violations(spark, sf_dir):
    return V.schema_violations(vendor_canonical(spark, sf_dir))


@query("duplicate_days", with_ctes(f"""
SELECT campaign_id, {sql_iso('date', 'day')}, count(*) AS n_rows FROM canonical GROUP BY campaign_id, date HAVING count(*) > 1""", "canonical"))
def duplicate_days(spark, sf_dir):
    return V.duplicate_days(ad_canonical(spark, sf_dir)).select("campaign_id", iso("date", "day"), "n_rows")


def by_brand(spark, sf_dir):
    """Campaigns keyed by brand alone, so that one id covers several types and names."""
    c = ad_canonical(spark, sf_dir)
    return c.withColumn("campaign_id", F.substring_index("campaign_name", " ", 1))


@query("multi_type_campaigns", with_ctes("""
SELECT split_part(campaign_name, ' ', 1) AS campaign_id, count(DISTINCT campaign_type) AS n_values, array_to_string(list_sort(list(DISTINCT campaign_type)), ',') AS seen
FROM canonical GROUP BY 1 HAVING count(DISTINCT campaign_type) > 1""", "canonical"))
def multi_type_campaigns(spark, sf_dir):
    return V.inconsistent(by_brand(spark, sf_dir), "campaign_type").withColumn("seen", F.array_join("seen", ","))


@query("multi_name_campaigns", with_ctes("""
SELECT split_part(campaign_name, ' ', 1) AS campaign_id, count(DISTINCT campaign_name) AS n_values, array_to_string(list_sort(list(DISTINCT campaign_name)), ',') AS seen
FROM canonical GROUP BY 1 HAVING count(DISTINCT campaign_name) > 1""", "canonical"))
def multi_name_campaigns(spark, sf_dir):
    return V.inconsistent(by_brand(spark, sf_dir), "campaign_name").withColumn("seen", F.array_join("seen", ","))


@query("run_summary", with_ctes(f"""
SELECT count(*) AS n_rows, count(DISTINCT campaign_id) AS n_campaigns, count(DISTINCT channel) AS n_channels, {sql_iso('min(date)', 'first_day')}, {sql_iso('max(date)', 'last_day')} FROM canonical""", "canonical"))
def run_summary(spark, sf_dir):
    s = V.run_summary(ad_canonical(spark, sf_dir))
    return s.select("n_rows", "n_campaigns", "n_channels", iso("first_date", "first_day"), iso("last_date", "last_day"))
