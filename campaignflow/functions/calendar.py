"""Calendar columns derived from one DATE column."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from campaignflow.functions.scalars import col

# Holiday windows as inclusive month-day numbers (MMDD).
HOLIDAY_WINDOWS = [(101, 107), (210, 214), (815, 905), (1120, 1202), (1218, 1231)]


def holiday_flag(date) -> Column:
    """1 inside a holiday window. Windows are recognised by month and day, so every year is treated alike."""
    d = col(date)
    mmdd = F.month(d) * 100 + F.dayofmonth(d)
    inside = F.lit(False)
    for low, high in HOLIDAY_WINDOWS:
        inside = inside | mmdd.between(low, high)
    return inside.cast("int")


def days_to_dec25(date) -> Column:
    """Signed days to 25 December: this year's from July on, last year's before."""
    d = col(date)
    year = F.year(d) - F.when(F.month(d) >= 7, 0).otherwise(1)
    return F.datediff(F.make_date(year, F.lit(12), F.lit(25)), d)


def calendar_columns(date) -> dict[str, Column]:
    d = col(date)
    return {
        "month": F.month(d),
        "week_of_year": F.weekofyear(d),
        "day_of_week": F.weekday(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (F.last_day(d) == d).cast("int"),
        "is_q4": (F.month(d) >= 10).cast("int"),
        "is_holiday_window": holiday_flag(d),
        "days_to_dec25": days_to_dec25(d),
    }


def iso_week_key(date) -> Column:
    """``iso_year * 100 + iso_week``; subtracting 100 names the same ISO week one year earlier."""
    d = col(date)
    return F.extract(F.lit("YEAROFWEEK"), d) * 100 + F.weekofyear(d)
