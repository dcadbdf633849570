"""What the ingestion report costs per row: names of files, numbers and counts are worked out once."""

from pyspark.sql import functions as F

from campaignflow.operators import canonical as C
from campaignflow.sources import files


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_and_owner_are_computed_once(spark):
    raw = spark.createDataFrame(
        [("1", "2024-01-01", "(1,234.50)", " 12% ", "7", "meta", "f", 1), ("", "x", "%(5)", "-", "", None, "f", 2)],
        "`read number` string, day string, `Spend.x` string, clicks string, rev string, ch string, source_file string, row_order long")
    mapping = {"read number": "campaign_id", "day": "date", "Spend.x": "spend", "clicks": "clicks", "rev": "revenue"}
    out = C.to_canonical(raw.withColumn("source_name", F.lit("a.csv")), mapping, None, F.lower("ch"), checks=True)
    plan = plan_of(out)
    assert plan.count("[eE]") == 3 and plan.count("lower(ch") <= 2
    rows = {r["row_order"]: r for r in out.collect()}
    assert (rows[1]["spend"], rows[1]["clicks"], rows[1]["channel"], rows[1]["filled"], rows[1]["failed"]) == (0.0, 12.0, "meta", [1, 1, 1], [0, 0, 0])
    assert (rows[2]["spend"], rows[2]["clicks"], rows[2]["channel"], rows[2]["filled"], rows[2]["failed"]) == (0.0, 0.0, "a", [1, 0, 1], [1, 0, 1])


def test_numbers_of_all_spellings(spark):
    want = {"(1,234.50)": -1234.5, "5%": 5.0, "(5%)": -5.0, "(5)%": None, "%": None, "(": None, "()": None, "$ 1 ": 1.0, "(-3)": -3.0, "€4\n": 4.0, "1(2)": None, "": None, "5%%": None}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", C.clean_number("t").alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == want


def test_report_of_many_files_uses_many_tasks_and_no_sorting(spark, tmp_path):
    for i, column in enumerate(("revenue", "Revenue", "conversion_value")):
        (tmp_path / f"google_ads {i}+.csv").write_text(f"campaign_id,date,spend,{column},notes\n7,2024-01-0{i + 1},$5,1,\"a\nb\"\n8,never,x,2,\n7,2024-02-01,1,(1),\n")
    data, report = files.ingest_directory(spark, str(tmp_path))
    assert data.rdd.getNumPartitions() > 1
    counts = C.file_report(spark.read.schema("source_file string, campaign_id string, channel string, date date, blank_id boolean, campaign_type string, filled array<int>, failed array<int>").parquet(
        str(_parquet(spark, tmp_path))), report.select(F.lit("f").alias("file"), F.col("source").alias("name"), "error", "mapped", "fuzzy", "ignored", "rejected", "missing", "revenue_confidence", F.array(F.lit("spend")).alias("fields")))
    assert "Expand" not in counts._jdf.queryExecution().executedPlan().toString()
    rows = report.orderBy("source").collect()
    assert [(r["n_rows"], r["n_dropped"], r["n_campaigns"], r["channel"]) for r in rows] == [(2, 1, 1, "google")] * 3
    assert all({p["field"]: (p["n_nonempty"], p["n_failed"]) for p in r["parsed"]}["spend"] == (3, 1) for r in rows)


def _parquet(spark, tmp_path):
    path = tmp_path / "checked"
    spark.createDataFrame([("f", "c", "x", None, False, "t", [1], [0])], "source_file string, campaign_id string, channel string, date date, blank_id boolean, campaign_type string, filled array<int>, failed array<int>").write.parquet(str(path))
    return path
