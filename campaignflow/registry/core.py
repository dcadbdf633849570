"""Query registry: a Spark callable and, where one exists, the DuckDB statement that must agree with it."""

from functools import wraps

from pyspark import StorageLevel
from pyspark.sql import Column
from pyspark.sql import functions as F

from campaignflow.functions.scalars import col

QUERIES = {}
ORACLES = {}
KEPT = []

# Engines break exact decimal ties differently; a shift far below the last kept digit, the same on both
# sides, moves ties off the rounding boundary.
SHIFT = {d: 2.718281828459045 * 10.0 ** -(d + 2) for d in (2, 3, 4, 6)}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def shared(fn):
    """Keep the frame of ``fn(spark, sf_dir)`` for the application: many queries read these same few tables.

    Lost blocks are recomputed from lineage; what does not fit in memory goes to executor disk.
    """
    kept = {}
    KEPT.append(kept)

    @wraps(fn)
    def get(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in kept:
            kept[key] = fn(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        return kept[key]

    return get


def release():
    """Forget the frames that queries share, so that the next query starts cold."""
    for kept in KEPT:
        for frame in kept.values():
            frame.unpersist()
        kept.clear()


def rnd(c, digits: int = 4) -> Column:
    return F.round(col(c) + F.lit(SHIFT[digits]), digits)


def rounded(digits: int, *names: str) -> list[Column]:
    return [rnd(n, digits).alias(n) for n in names]


def iso(c="date", name: str | None = None) -> Column:
    """A DATE as ISO text."""
    out = F.date_format(col(c), "yyyy-MM-dd")
    return out.alias(name or (c if isinstance(c, str) else "date"))


def sql_rnd(expr: str, digits: int = 4) -> str:
    return f"round({expr} + {SHIFT[digits]!r}::DOUBLE, {digits})"


def sql_rounded(digits: int, *names: str) -> str:
    return ", ".join(f"{sql_rnd(n, digits)} AS {n}" for n in names)


def sql_iso(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"


def compose(ctes: dict[str, str], body: str, *names: str) -> str:
    """``WITH`` the named definitions, in the given order, in front of ``body``."""
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in names) + "\n" + body
