"""Small hand-made frames shared by the tests."""

import datetime

import pandas as pd

from campaignflow.schema import CANONICAL

START = datetime.date(2024, 1, 1)
DAY = datetime.timedelta(days=1)
COLUMNS = [*CANONICAL, "row_order"]
SCHEMA = ("channel string, campaign_id string, campaign_name string, date date, spend double, revenue double, conversions double, "
          "clicks double, impressions double, reach double, video_views double, campaign_type string, daily_budget double, row_order long")


def row(i=0, campaign="a::1", channel="a", kind="search", spend=100.0, revenue=400.0, day=None, **more):
    base = dict(channel=channel, campaign_id=campaign, campaign_name=campaign, date=day or START + i * DAY, spend=spend, revenue=revenue,
                conversions=5.0, clicks=50.0, impressions=1000.0, reach=400.0, video_views=200.0, campaign_type=kind, daily_budget=None, row_order=i)
    return {**base, **more}


def canonical(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)


def group_days(spark, rows):
    """Rows of (channel, type, day offset, spend, revenue)."""
    return spark.createDataFrame(
        [(c, t, START + i * DAY, float(s), float(r)) for c, t, i, s, r in rows],
        "channel string, campaign_type string, date date, spend double, revenue double")


def pdf(df, *order) -> pd.DataFrame:
    out = df.toPandas()
    return out.sort_values(list(order)).reset_index(drop=True) if order else out
