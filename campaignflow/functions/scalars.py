"""Column helpers shared by every operator."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(numerator, denominator) -> Column:
    """``n / d``, NULL (never 0 or infinity) where the denominator is 0."""
    return col(numerator) / F.nullif(col(denominator), F.lit(0.0))


def clip(c, low=None, high=None) -> Column:
    """Clamp a non-null column; a NULL stays NULL."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def first_by(value: str, order: str) -> Column:
    """Aggregate: the non-null ``value`` that comes first in ``order`` (mergeable, so it pre-aggregates)."""
    pair = F.struct(col(order).alias("o"), col(value).alias("v"))
    return F.min(F.when(col(value).isNotNull(), pair))["v"]


def ordered_rules(subject: Column, rules, otherwise) -> Column:
    """First regular expression that matches ``subject`` decides the label."""
    out = None
    for pattern, label in rules:
        hit = subject.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)
