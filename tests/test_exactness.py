"""Results that must not depend on ties, quoting, missing ids or missing history."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaignflow.functions.quantiles import exact_quantiles
from campaignflow.operators.canonical import to_canonical
from campaignflow.operators.hierarchy import reconcile
from campaignflow.schema import QUANTILE_COLUMNS
from campaignflow.sources.files import read_raw

TIES = {
    "two masses": [0.0] * 500 + [1.0] * 500,
    "mass beside a tail": [0.0] * 500 + [float(i) for i in range(1, 501)],
    "all equal": [3.0] * 1000,
    "distinct": [float(i) * 0.37 for i in range(999)],
    "negative and positive mass": [-2.0] * 333 + [0.0] * 333 + [7.0] * 334,
}


@pytest.mark.parametrize("limit", [5, 100_000])
@pytest.mark.parametrize("name", TIES)
def test_quantiles_end_and_are_exact(spark, name, limit):
    values = TIES[name]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    levels = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {str(q): ("v", q) for q in levels}, limit=limit)
    for q in levels:
        assert got[str(q)][2] == pytest.approx(np.quantile(values, q))


def test_quoted_cells_keep_their_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('campaign_name,spend\nplain,1\n"with ""quotes"", and comma",2\n"two\nlines",3\n')
    rows = read_raw(spark, str(tmp_path / "a.csv")).orderBy("row_order").collect()
    assert [r["campaign_name"] for r in rows] == ["plain", 'with "quotes", and comma', "two\nlines"]


def test_a_blank_id_keeps_its_namespace(spark):
    raw = spark.createDataFrame([("2024-01-01", None, "1", "2")], "d string, i string, s string, r string")
    out = to_canonical(raw, {"d": "date", "i": "campaign_id", "s": "spend", "r": "revenue"}, "x.csv", "meta").first()
    assert out["campaign_id"] == "meta::nan"


def test_a_new_campaign_counts_at_every_level(spark):
    history = spark.createDataFrame([("c", "t", "old", 30, i, 100.0, 90.0) for i in range(20)],
                                    "channel string, campaign_type string, campaign_id string, horizon_days int, origin_date int, target_revenue double, prediction double")
    live = spark.createDataFrame([("c", "t", i, 30) for i in ("old", "new")], "channel string, campaign_type string, campaign_id string, horizon_days int")
    nodes = reconcile(live.withColumns({q: F.lit(100.0) for q in QUANTILE_COLUMNS}), history).collect()
    assert {r["level"]: r["reconciled_median"] for r in nodes if r["level"] != "campaign"} == {"total": 200.0, "channel": 200.0, "campaign_type": 200.0}
    assert sum(r["level"] == "campaign" for r in nodes) == 2
