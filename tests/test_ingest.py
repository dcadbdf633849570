import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignflow.functions.text_match import name_score
from campaignflow.operators import canonical as C
from campaignflow.operators import mapping as M
from campaignflow.operators import validation as V
from campaignflow.schema import CANONICAL_SCHEMA
from campaignflow.sources import files
from tests.helpers import START, canonical, pdf, row


@pytest.mark.parametrize("a,b,want", [("costlocal", "cost", 80.8), ("adspendusd", "adspend", 91.2), ("campnm", "campname", 88.3)])
def test_name_scores(a, b, want):
    assert name_score(a, b) == pytest.approx(want, abs=0.05)


def test_assignment_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        scores = rng.uniform(40, 100, (4, 3))
        valid = scores >= 65
        got = M.best_assignment(scores, valid)
        taken = [f for f in got if f >= 0]
        assert len(taken) == len(set(taken))
        assert all(valid[i, f] for i, f in enumerate(got) if f >= 0)

        def value(pick):
            used = [f for f in pick if f >= 0]
            if len(used) != len(set(used)) or any(f >= 0 and not valid[i, f] for i, f in enumerate(pick)):
                return -1
            return sum(1e6 + scores[i, f] for i, f in enumerate(pick) if f >= 0)

        best = max(value(p) for p in itertools.product([-1, 0, 1, 2], repeat=4))
        assert value(got) == pytest.approx(best)


@pytest.mark.parametrize("order", [["Cost_Local", "Ad_Spend_USD"], ["Ad_Spend_USD", "Cost_Local"]])
def test_better_column_wins_in_either_order(spark, order):
    headers = {"f.csv": ["CampaignId", "TimePeriod", "Revenue", *order]}
    got = {r["raw_col"]: r["field"] for r in M.map_columns(files.catalogue(spark, headers)).collect()}
    assert got["Ad_Spend_USD"] == "spend"
    assert got["Cost_Local"] != "spend"


def test_number_formats(spark):
    cases = {"$1,234.56": 1234.56, "(500.00)": -500.0, "12.5%": 12.5, "1,000": 1000.0, " 42 ": 42.0, "€10": 10.0, "£5": 5.0,
             "": None, "nan": None, "n/a": None, "1d": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("v", C.clean_number("s"))
    assert {r["s"]: r["v"] for r in df.collect()} == cases


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-05 10:00:00",), ("1/5/2024",), ("2024/1/5",), ("soon",)], "s string")
    got = [str(r["d"]) for r in df.select(C.parse_date("s").alias("d")).collect()]
    assert got == ["2024-01-05"] * 4 + ["None"]


def write(path, header, rows):
    path.write_text("\n".join([",".join(header), *[",".join(str(c) for c in r) for r in rows]]) + "\n")


def test_directory_of_mangled_exports(spark, tmp_path):
    write(tmp_path / "google_ads_campaign_stats.csv", ["", "campaign_id", "campaign_name", "segments_date", "metrics_cost_micros", "metrics_conversions_value"],
          [[0, 7, "Brand x", "2024-01-01", 2500000, 10.0], [1, 7, "Brand x", "bad", 1, 1]])
    write(tmp_path / "odd name.csv", ["CampaignId", "Camp_Nm", "TimePeriod", "Cost_Local", "Revenue", "junk_1"],
          [[7, "Shop all", "2024-01-02", '"$1,000.50"', "(3)", "z"]])
    write(tmp_path / "meta_ads.csv", ["campaign_id", "date_start", "spend", "conversion"], [[1, "2024-01-03", -4, 6]])
    write(tmp_path / "broken.csv", ["alpha", "beta"], [[1, 2]])
    data, report = files.ingest_directory(spark, str(tmp_path))
    assert V.type_problems(data, CANONICAL_SCHEMA) == []
    got = {r["campaign_id"]: r for r in data.collect()}
    assert set(got) == {"google::7", "odd name::7", "meta::1"}
    assert got["google::7"]["spend"] == 2.5 and got["google::7"]["campaign_type"] == "brand"
    assert got["odd name::7"]["spend"] == 1000.5 and got["odd name::7"]["revenue"] == 0.0
    assert got["odd name::7"]["campaign_type"] == "shopping" and got["odd name::7"]["clicks"] is None
    assert got["meta::1"]["spend"] == 0.0 and got["meta::1"]["revenue"] == 6.0 and got["meta::1"]["daily_budget"] is None
    rows = {r["source"]: r for r in report.collect()}
    assert rows["broken.csv"]["error"] and rows["meta_ads.csv"]["revenue_confidence"] == "proxy"
    assert "campaign_name" in rows["odd name.csv"]["fuzzy"]
    assert report.count() == 4 and files.report_lines(report).count() == 4


def test_file_without_a_date_is_refused(spark, tmp_path):
    write(tmp_path / "x.csv", ["CampaignId", "Spend", "Revenue"], [[1, 2, 3]])
    with pytest.raises(ValueError, match="date"):
        files.ingest_file(spark, str(tmp_path / "x.csv"))


def test_blank_column_warning(spark):
    raw = spark.createDataFrame([("", "1"), (" ", "x"), ("nan", "2")], "a string, b string")
    got = {r["field"]: r for r in C.parse_report(raw, {"spend": "a", "revenue": "b"}).collect()}
    assert got["spend"]["warn_all_blank"] and not got["revenue"]["warn_all_blank"]
    assert got["revenue"]["n_failed"] == 1 and got["revenue"]["example"] == "x" and got["revenue"]["warn_unparsed"]


def test_consistency_checks(spark):
    clean = [row(i) for i in range(10)]
    assert V.duplicate_days(canonical(spark, clean)).count() == 0
    dirty = canonical(spark, [*clean, row(3), row(11, kind="brand"), row(12, campaign_name="other")])
    assert V.duplicate_days(dirty).first()["n_rows"] == 2
    assert V.inconsistent(dirty, "campaign_type").first()["seen"] == ["brand", "search"]
    assert V.inconsistent(dirty, "campaign_name").count() == 1
    bad = {(r["rule"], r["field"]): r["n_failures"] for r in V.schema_violations(canonical(spark, [row(clicks=-1.0)])).collect()}
    assert bad[("non_negative", "clicks")] == 1 and sum(bad.values()) == 1


def test_sinks_and_optional_read(spark, tmp_path):
    df = canonical(spark, [row(i) for i in range(3)]).drop("row_order")
    files.write_parquet(df, str(tmp_path / "p"))
    files.write_csv(df, str(tmp_path / "c"), ["date"])
    files.write_json(df, str(tmp_path / "j"))
    files.write_text(df.select(F.col("campaign_id").alias("value")), str(tmp_path / "t"))
    assert files.read_optional(spark, str(tmp_path / "p"), CANONICAL_SCHEMA).count() == 3
    assert files.read_optional(spark, str(tmp_path / "none"), CANONICAL_SCHEMA).count() == 0
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    back = files.ingest_file(spark, str(tmp_path / "c"), "a")
    assert pdf(back, "date")["spend"].tolist() == [100.0] * 3 and back.first()["date"] == START


def test_cleaning_stays_small_enough_to_be_compiled(spark, capsys):
    import re

    from campaignflow.operators.canonical import DATE_FORMATS, clean_number, parse_date
    from pyspark.sql import functions as F

    texts = ["1/2/2020", "01/02/12020", "-1/2/2020", "2020/1/2", "+12020/1/2", "3-Jan-2021", "03-jan-2021", "Jan 3, 2021", "Jan 3,2021", "2020-02-30", "2020", "13/13/2020", "1/2/20", "", None, "x", " 1/2/2020 ", "1/2/2020\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(F.trim("t").try_cast("date"), *[F.to_date(F.try_to_timestamp(F.trim("t"), F.lit(f))) for f in DATE_FORMATS])
    assert all(r[0] == r[1] for r in df.select(parse_date("t").cast("string"), plain.cast("string")).collect())
    df.repartition(2).select(*[clean_number("t").alias(f"n{i}") for i in range(8)], parse_date("t")).explain("codegen")
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))
