"""Value cleaning and projection of raw string frames onto the canonical columns."""

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignflow.functions.scalars import col, ordered_rules
from campaignflow.operators.mapping import plain
from campaignflow.schema import CANONICAL, CHANNEL_GLOBS, OPTIONAL, TYPE_PATTERNS, UNCLASSIFIED, UNIT_DIVISORS

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Accepted date formats after ISO, and what every text of a format matches, so that others need not be tried.
DATE_FORMATS = ["M/d/yyyy", "yyyy/M/d", "d-MMM-yyyy", "MMM d, yyyy"]
DATE_SHAPES = [r"/[+-]?\d{4,}$", r"^[+-]?\d{4,}/", r"^[+-]?\d+-\D", r", [+-]?\d{4,}$"]
BLANK_TYPES = ["", "nan", "None"]
NUMERIC_FIELDS = ["spend", "revenue", "conversions", "clicks", "impressions", "reach", "video_views", "daily_budget"]
# Fixed value: share of filled cells that may fail to parse before a warning.
WARN_SHARE = 0.02


def once(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once.

    Written out, the repeats of a value make the generated code of a projection so large that the JVM never compiles it.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def clean_number(c) -> Column:
    """Currency signs, thousands separators, trailing percent and accounting negatives to DOUBLE; else NULL."""

    def number(text):
        # Patterns are tried only where the character they begin or end with is there.
        opened, percent = text.startswith("("), text.contains("%")
        inner = F.when(opened, F.regexp_replace(text, r"^\((.*)\)$", "$1")).otherwise(text)
        whole = F.when(percent, F.regexp_replace(inner, "%$", "")).otherwise(inner)
        value = once(F.regexp_replace(whole, r"[,$€£₹\s]", ""), lambda d: F.when(d.rlike(NUMBER), d.try_cast("double")))
        return once(value, lambda v: F.when(opened & text.rlike(r"^\(.*\)$"), -F.abs(v)).otherwise(v))

    return once(F.trim(col(c).cast("string")), number)


def is_filled(c) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.coalesce((text != "") & (F.lower(text) != "nan"), F.lit(False))


def parse_date(c) -> Column:
    """Day of an ISO date or timestamp, or of one of the other accepted formats; NULL if none fits."""

    def day(text):
        formats = [F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(f)))) for f, shape in zip(DATE_FORMATS, DATE_SHAPES, strict=True)]
        return F.coalesce(text.try_cast("date"), *formats)

    return once(F.trim(col(c).cast("string")), day)


def infer_type(name) -> Column:
    return ordered_rules(F.lower(F.coalesce(col(name), F.lit(""))), TYPE_PATTERNS, UNCLASSIFIED)


def campaign_type(native, name) -> Column:
    text = F.trim(col(native))
    return F.when(text.isNull() | text.isin(BLANK_TYPES), infer_type(name)).otherwise(text)


def glob_pattern(glob: str) -> str:
    return "^" + ".*".join(part.replace(".", r"\.") for part in glob.lower().split("*")) + "$"


def channel_of_file(name) -> Column:
    """Channel by file-name pattern, NULL when none matches."""
    rules = [("|".join(glob_pattern(g) for g in globs), channel) for channel, globs in CHANNEL_GLOBS]
    return ordered_rules(F.lower(col(name)), rules, None)


def parse_report(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per numeric column: non-empty cells, failures, an example, and the two warnings.

    ``columns`` maps canonical field to raw column. All columns are measured in one pass.
    """
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for field, c in columns.items():
        failed = is_filled(c) & clean_number(c).isNull()
        aggs += [F.count_if(is_filled(c)).alias(f"n_{field}"), F.count_if(failed).alias(f"f_{field}"),
                 F.min(F.when(failed, F.trim(col(c)))).alias(f"e_{field}")]
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n_nonempty"), F.col(f"f_{f}").alias("n_failed"),
                 F.col(f"e_{f}").alias("example")) for f in columns])
    return raw.agg(*aggs).select("n_total", F.explode(cells).alias("c")).select(
        "c.field", "n_total", "c.n_nonempty", "c.n_failed", "c.example",
        (F.col("c.n_failed") > F.col("c.n_nonempty") * WARN_SHARE).alias("warn_unparsed"),
        ((F.col("c.n_nonempty") == 0) & (F.col("n_total") > 0)).alias("warn_all_blank"))


#: Columns that ``to_canonical`` adds with ``checks``: file, place, missing id, and which numeric cells are filled and cannot be read.
CHECKS = ("source_file", "row_order", "blank_id", "filled", "failed")


def checked_fields(mapping: dict[str, str]) -> list[str]:
    """Numeric fields of a mapping, in the order of ``filled`` and ``failed``."""
    return [f for f in NUMERIC_FIELDS if f in mapping.values()]


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column begins with it."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def to_canonical(raw: DataFrame, mapping: dict[str, str], source: str | None, channel: str | Column | None = None, checks: bool = False) -> DataFrame:
    """Project a raw frame through ``mapping`` (raw column -> field) onto the canonical columns.

    Rows without a parseable date are dropped. A field the file lacks is NULL everywhere; a blank cell of a
    field it has counts as 0, except the budget. Without revenue, conversions stand in for it. Without ``source`` the file's name
    is in ``source_name``. With ``checks`` all rows stay, and columns say what is wrong with each.
    """
    by_field = {field: raw_col for raw_col, field in mapping.items()}
    # Numbers and the owner stand in columns of their own, so that each is computed once however often it is used.
    prefix = unused("read ", raw.columns)

    def read_number(field: str) -> Column:
        c = by_field[field]
        divisor = UNIT_DIVISORS.get(plain(c))
        return clean_number(text(field)) / divisor if divisor else clean_number(text(field))

    def number(field: str) -> Column:
        return F.col(f"`{prefix}{field}`")

    def text(field: str) -> Column:
        return F.col("`" + by_field[field].replace("`", "``") + "`").cast("string")

    def activity(field: str) -> Column:
        return F.coalesce(number(field), F.lit(0.0))

    missing = F.lit(None).cast("double")
    ident = text("campaign_id")
    name = F.coalesce(text("campaign_name"), F.lit("nan")) if "campaign_name" in by_field else ident
    stem = F.lit(os.path.splitext(source)[0].lower()) if source is not None else F.lower(F.regexp_replace("source_name", r"(?<=.)\.[^.]*$", ""))
    fallback = F.lower(text("channel")) if "channel" in by_field else stem
    if isinstance(channel, Column):
        owner = F.when(channel.isNotNull(), channel).otherwise(fallback)
    else:
        owner = F.lit(channel) if channel else fallback
    raw = raw.withColumns({f"{prefix}{f}": read_number(f) for f in NUMERIC_FIELDS if f in by_field} | {f"{prefix}channel": owner})
    owner = number("channel")
    kind = campaign_type(text("campaign_type"), name) if "campaign_type" in by_field else infer_type(name)
    columns = {
        "channel": owner,
        "campaign_id": F.concat_ws("::", F.coalesce(owner, F.lit("nan")), F.coalesce(ident, F.lit("nan"))),
        "campaign_name": name,
        "date": parse_date(text("date")),
        "spend": F.greatest(activity("spend"), F.lit(0.0)),
        "revenue": F.greatest(activity("revenue" if "revenue" in by_field else "conversions"), F.lit(0.0)),
        "campaign_type": kind,
        "daily_budget": number("daily_budget") if "daily_budget" in by_field else missing,
    }
    for field in ("conversions", "clicks", "impressions", "reach", "video_views"):
        columns[field] = activity(field) if field in by_field else missing
    if not checks:
        extra = [c for c in ("row_order",) if c in raw.columns]
        return raw.select(*[columns[c].alias(c) for c in CANONICAL], *extra).where(F.col("date").isNotNull())
    fields = checked_fields(mapping)
    filled = [is_filled(text(f)) for f in fields]
    failed = [x & number(f).isNull() for f, x in zip(fields, filled, strict=True)]
    blank = F.coalesce(F.trim(ident), F.lit("")).isin(BLANK_TYPES)
    return raw.select(
        *[columns[c].alias(c) for c in CANONICAL], "source_file", "row_order", blank.alias("blank_id"),
        F.array(*[x.cast("int") for x in filled]).alias("filled"), F.array(*[x.cast("int") for x in failed]).alias("failed"))


def file_report(checked: DataFrame, described: DataFrame) -> DataFrame:
    """Per file of ``described``: rows, campaigns, days, dropped dates, blank ids, unclassified rows, parse failures and warnings.

    ``checked`` has the columns of ``CHECKS``; ``described`` is a row per file with its mapping and the names of its numeric fields.
    A file in which no row has a date gets an error.
    """
    dated = F.col("date").isNotNull()
    at = range(len(NUMERIC_FIELDS))
    cells = [f"{kind}{i}" for kind in ("filled", "failed") for i in at]
    # Numbers by file and campaign first: they are added up in hash tables before anything is shuffled or sorted.
    campaigns = checked.groupBy(F.col("source_file").alias("file"), "campaign_id", "channel").agg(
        F.count_if(dated).alias("n_rows"), F.count_if(~dated).alias("n_dropped"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(F.col("blank_id")).alias("n_blank_ids"), F.count_if(dated & (F.lower("campaign_type") == UNCLASSIFIED)).alias("n_unclassified"),
        *[F.sum(F.get(kind, F.lit(i))).alias(f"{kind}{i}") for kind in ("filled", "failed") for i in at])
    counted = F.col("n_rows") > 0
    counts = campaigns.groupBy("file").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_dropped", "n_blank_ids", "n_unclassified", *cells)],
        F.count_distinct(F.when(counted, F.col("campaign_id"))).alias("n_campaigns"), F.min(F.when(counted, F.col("channel"))).alias("channel"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")).withColumns({
            kind: F.array(*[F.coalesce(f"{kind}{i}", F.lit(0).cast("long")) for i in at]) for kind in ("filled", "failed")}).drop(*cells)
    fields = F.transform("fields", lambda f, i: F.struct(f.alias("field"), F.get("filled", i).alias("n_nonempty"), F.get("failed", i).alias("n_failed")))
    joined = described.join(counts, "file", "left").withColumn("parsed", fields)
    n_all = F.col("n_rows") + F.col("n_dropped")
    unreadable = F.filter("parsed", lambda p: p["n_failed"] > p["n_nonempty"] * WARN_SHARE)
    empty = F.filter("parsed", lambda p: (p["n_nonempty"] == 0) & (n_all > 0))
    warnings = F.concat(
        F.transform(unreadable, lambda p: F.format_string("%s: %d of %d cells are not numbers", p["field"], p["n_failed"], p["n_nonempty"])),
        F.transform(empty, lambda p: F.concat(p["field"], F.lit(": no cell is filled"))),
        F.when(F.col("n_dropped") > 0, F.array(F.format_string("%d rows without a date dropped", "n_dropped"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("n_blank_ids") > 0, F.array(F.format_string("%d rows without a campaign id", "n_blank_ids"))).otherwise(F.array().cast("array<string>")))
    undated = F.when(F.coalesce("n_rows", F.lit(0)) == 0, F.lit("no row has a date that can be read"))
    count = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_rows", "n_dropped", "n_campaigns", "n_blank_ids", "n_unclassified")}
    return joined.select(
        F.col("name").alias("source"), "channel", F.coalesce("error", undated).alias("error"), *count.values(), "first_date", "last_date",
        "mapped", "fuzzy", "ignored", "rejected", "missing", "revenue_confidence", "parsed",
        F.coalesce(warnings, F.array().cast("array<string>")).alias("warnings"))


def missing_fields(mapping: dict[str, str]) -> list[str]:
    """Required fields a mapping lacks; empty when the file is usable."""
    fields = set(mapping.values())
    lacking = [f for f in ("date", "campaign_id", "spend") if f not in fields]
    if not fields & {"revenue", "conversions"}:
        lacking.append("revenue or conversions")
    return lacking


def ingestion_report(canonical: DataFrame, by: str = "channel") -> DataFrame:
    """Rows, campaigns, date range and unclassified rows per source."""
    return canonical.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("campaign_id").alias("n_campaigns"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(F.lower("campaign_type") == UNCLASSIFIED).alias("n_unclassified"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in OPTIONAL if c != "campaign_type"])
