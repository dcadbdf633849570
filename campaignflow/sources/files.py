"""CSV ingestion, optional reads, and the CSV / JSON / parquet / text sinks."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignflow.operators.canonical import channel_of_file, checked_fields, file_report, missing_fields, to_canonical, unused
from campaignflow.operators.mapping import map_columns
from campaignflow.schema import CANONICAL
from campaignflow.sources.csv_splits import header_names, read_records, survey
from campaignflow.sources.workdir import stored

def read_raw(spark: SparkSession, paths) -> DataFrame:
    """Rows of header CSV files of one layout: every column a string, ``source_file``, and ``row_order``, the place in its files.

    Quoted cells may hold commas, line breaks and doubled quotes; large files are read by many tasks all the same.
    """
    surveyed, opened = survey_paths(spark, [paths] if isinstance(paths, str) else list(paths))
    if not surveyed:
        raise ValueError("a CSV file needs a header line")
    return raw_rows(spark, opened, header_names(next(iter(surveyed.values()))["header"]), surveyed)


def survey_paths(spark: SparkSession, paths: list[str]) -> tuple[dict[str, dict], dict[str, str]]:
    """What ``survey`` finds in each file, and the path under which each is opened."""
    surveyed = survey(spark, paths)
    jvm = spark._jvm
    return surveyed, {f: jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in surveyed}


def raw_rows(spark: SparkSession, paths: dict[str, str], names: list[str], surveyed: dict[str, dict]) -> DataFrame:
    rows = read_records(spark, paths, names, surveyed)
    return rows.drop(names[0]) if is_index_column(names[0]) else rows


def is_index_column(name: str) -> bool:
    return name == "" or name.lower().startswith("unnamed") or name == "_c0"


def catalogue(spark: SparkSession, headers: dict[str, list[str]]) -> DataFrame:
    rows = [(source, i, c) for source, columns in headers.items() for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "source string, pos int, raw_col string")


def list_csv(spark: SparkSession, directory: str) -> list[str]:
    """Sorted CSV paths of a directory on any Hadoop file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*.csv"))
    return sorted(s.getPath().toString() for s in found or [])


def ingest_directory(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Map every CSV of a directory onto the canonical table; a file that cannot be used becomes an error row of the report.

    One scan settles headers and splits of all files; names are matched once per distinct header; files with the same header are
    read by one scan. The canonical rows are written once, with what is wrong with each, and the report counts them there. A file
    in which no row has a date is refused.
    """
    listed = list_csv(spark, directory)
    surveyed, opened = survey_paths(spark, listed) if listed else ({}, {})
    headers = {h: header_names(h) for h in {own["header"] for own in surveyed.values()}}
    matched = {}
    if headers:
        named = {h: [c for i, c in enumerate(names) if not (i == 0 and is_index_column(c))] for h, names in headers.items()}
        for r in map_columns(catalogue(spark, named)).collect():  # a row per column of each distinct header
            matched.setdefault(r["source"], []).append(r)
    schema = "file string, name string, error string, mapped map<string,string>, fuzzy map<string,string>, ignored array<string>, rejected array<string>, missing array<string>, revenue_confidence string, fields array<string>"
    described, parts = [], []
    for header, names in headers.items():
        rows = sorted(matched.get(header, []), key=lambda r: r["pos"])
        chosen = {r["raw_col"]: r["field"] for r in rows if r["field"] is not None}
        lacking = missing_fields(chosen)
        own = {f: opened[f] for f in opened if surveyed[f]["header"] == header}
        facts = (
            f"no column for: {', '.join(lacking)}" if lacking else None,
            {r["field"]: r["raw_col"] for r in rows if r["method"] == "exact"},
            {r["field"]: f"{r['raw_col']} ({r['score']})" for r in rows if r["method"] == "fuzzy"},
            [r["raw_col"] for r in rows if r["method"] == "ignored"],
            [f"{r['raw_col']} ~ {r['nearest_field']} ({r['score']})" for r in rows if r["method"] == "ignored" and r["nearest_field"]],
            [f for f in CANONICAL if f not in chosen.values() and f != "channel"],
            "direct" if "revenue" in chosen.values() else "proxy", checked_fields(chosen))
        described += [(f, os.path.basename(path), *facts) for f, path in own.items()]
        if not lacking:
            raw = raw_rows(spark, own, names, surveyed)
            channel = unused("channel of the file", names)
            # A name is taken apart once per file, not per row.
            files = spark.createDataFrame([(f,) for f in own], "source_file string").withColumn(
                "source_name", F.element_at(F.split(F.url_decode(F.replace("source_file", F.lit("+"), F.lit("%2B"))), "/"), -1))
            raw = raw.join(F.broadcast(files.withColumn(channel, channel_of_file("source_name"))), "source_file")  # a row per file of the listing
            parts.append(to_canonical(raw, chosen, None, F.col(channel), checks=True))
    described += [(None, os.path.basename(p), "no header line", {}, {}, [], [], [], None, []) for p in listed if p not in set(opened.values())]
    if not parts:
        raise FileNotFoundError(f"no file in '{directory}' can be used" if listed else f"no CSV file in '{directory}'")
    canonical = parts[0]
    for part in parts[1:]:
        canonical = canonical.unionByName(part)
    canonical = stored(canonical, "canonical", spark)  # not by the session of fixed splits, which reads small files in one task
    report = file_report(canonical, spark.createDataFrame(described, schema))
    return canonical.where(F.col("date").isNotNull()).select(*CANONICAL, "row_order"), report


def ingest_file(spark: SparkSession, path: str, channel: str | None = None) -> DataFrame:
    """One CSV onto the canonical table; raises when a required field cannot be found or no row has a date."""
    raw = read_raw(spark, path)
    name = os.path.basename(path)
    header = {path: [c for c in raw.columns if c not in ("row_order", "source_file")]}
    chosen = {r["raw_col"]: r["field"] for r in map_columns(catalogue(spark, header)).collect() if r["field"]}
    lacking = missing_fields(chosen)
    if lacking:
        raise ValueError(f"{name}: no column for {', '.join(lacking)}")
    out = to_canonical(raw, chosen, name, channel)
    if out.isEmpty():
        raise ValueError(f"{name}: no row has a date that can be read")
    return out


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The data at ``path``, or an empty frame of ``schema`` when nothing is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).load(path)


def write_csv(df: DataFrame, path: str, order=()) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_text(lines: DataFrame, path: str) -> None:
    """One string column, a line per row."""
    lines.write.mode("overwrite").text(path)


def report_lines(report: DataFrame) -> DataFrame:
    """Ingestion report as text, one line per file."""
    ok = F.format_string(
        "%s (channel=%s): %d rows, %d campaigns, %s to %s; %d without a date, %d without an id, %d unclassified; mapped %s; fuzzy %s; ignored %s; missing %s; revenue %s; %s",
        "source", F.coalesce("channel", F.lit("?")), "n_rows", "n_campaigns", F.col("first_date").cast("string"), F.col("last_date").cast("string"),
        "n_dropped", "n_blank_ids", "n_unclassified", F.to_json("mapped"), F.to_json("fuzzy"), F.array_join("ignored", ", "),
        F.array_join("missing", ", "), "revenue_confidence", F.coalesce(F.nullif(F.array_join("warnings", "; "), F.lit("")), F.lit("no warnings")))
    bad = F.format_string("%s: ERROR %s", "source", "error")
    return report.select(F.when(F.col("error").isNotNull(), bad).otherwise(ok).alias("value"))


def run_lines(report: DataFrame) -> DataFrame:
    """One row: files used and refused, rows and dropped rows, campaigns counted per file."""
    used = F.col("error").isNull()
    return report.agg(
        F.count_if(used).alias("n_files"), F.count_if(~used).alias("n_refused"), F.coalesce(F.sum(F.when(used, F.col("n_rows"))), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("n_dropped"), F.lit(0)).alias("n_dropped"))
