"""Quantile helpers: crossing repairs and exact quantiles of unbounded columns."""

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignflow.functions.scalars import col

# Rows of one bracket that may be sorted in a single task.
SORT_LIMIT = 100_000


def sort_row(columns) -> list[Column]:
    """Repair crossing quantiles by sorting them within the row."""
    ordered = F.array_sort(F.array(*[col(c) for c in columns]))
    return [ordered[i] for i in range(len(columns))]


def pin_median(columns, middle: int) -> list[Column]:
    """Repair crossing without moving the median: floor at 0, then running min leftwards and max rightwards."""
    out = [F.greatest(col(c), F.lit(0.0)) for c in columns]
    for i in range(middle - 1, -1, -1):
        out[i] = F.least(out[i], out[i + 1])
    for i in range(middle + 1, len(out)):
        out[i] = F.greatest(out[i], out[i - 1])
    return out


def exact_quantiles(df: DataFrame, targets, limit: int = SORT_LIMIT) -> dict[str, tuple]:
    """Linear-interpolated quantile of whole columns, exact at any size.

    ``targets`` maps a name to (column, level), the level being a number or a function of the row count; the
    result maps it to (row count, level, value). The two ranks beside a level are looked for separately. Each
    pass takes a bracket of data values around a rank from a mergeable sketch, counts what is below, at and
    between its ends, and either ends at one of them or goes on strictly between. So every pass removes both
    ends with all their ties, and as a rule all but 1/1000 of the bracket; only a bracket of ``limit`` counted
    rows or fewer is sorted. The driver sees a handful of scalars per pass.
    """
    names = list(targets)
    df = df.select(*{targets[n][0] for n in names}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _select_ranks(df, targets, names, limit)
    finally:
        df.unpersist()


def _select_ranks(df: DataFrame, targets, names, limit) -> dict[str, tuple]:
    sizes = df.agg(*[F.count(targets[n][0]).alias(n) for n in names]).first()
    done, ranks, open_ranks, found = {}, {}, {}, {}
    for n in names:
        level = None
        if sizes[n]:
            ask = targets[n][1]
            level = ask(sizes[n]) if callable(ask) else ask
            h = (sizes[n] - 1) * level
            ranks[n] = (math.floor(h), math.ceil(h), h - math.floor(h))
            for rank in ranks[n][:2]:
                open_ranks[targets[n][0], rank] = {"low": None, "high": None, "below": 0, "inside": sizes[n]}
        done[n] = (sizes[n], level)

    def inside(key):
        c, s = F.col(key[0]), open_ranks[key]
        kept = c.isNotNull()
        if s["low"] is not None:
            kept = kept & (c > s["low"]) & (c < s["high"])
        return F.when(kept, c)

    while wide := [k for k, s in open_ranks.items() if s["inside"] > limit]:
        asks = []
        for i, k in enumerate(wide):
            p = (k[1] - open_ranks[k]["below"]) / max(open_ranks[k]["inside"] - 1, 1)
            asks.append(F.percentile_approx(inside(k), [max(p - 5e-4, 0.0), min(p + 5e-4, 1.0)], 20000).alias(f"k{i}"))
        brackets = df.agg(*asks).first()
        counts = []
        for i, k in enumerate(wide):
            c, (low, high) = inside(k), brackets[f"k{i}"]
            tests = {"l": c < low, "a": c == low, "m": (c > low) & (c < high), "b": c == high}
            counts += [F.count_if(test).alias(f"{name}{i}") for name, test in tests.items()]
        got = df.agg(*counts).first()
        for i, k in enumerate(wide):
            s, (low, high) = open_ranks[k], brackets[f"k{i}"]
            first = s["below"] + got[f"l{i}"]
            middle = first + got[f"a{i}"]
            last = middle + got[f"m{i}"]
            if first <= k[1] < middle or low == high and first <= k[1]:
                found[k] = low
            elif middle <= k[1] < last:
                open_ranks[k] = {"low": low, "high": high, "below": middle, "inside": got[f"m{i}"]}
            elif last <= k[1] < last + got[f"b{i}"]:
                found[k] = high
            else:
                raise ValueError(f"the bracket of {k} lost its rank")
        open_ranks = {k: s for k, s in open_ranks.items() if k not in found}

    if rest := list(open_ranks):
        lists = df.agg(*[F.sort_array(F.collect_list(inside(k))).alias(f"k{i}") for i, k in enumerate(rest)])
        picked = lists.select(*[F.col(f"k{i}")[k[1] - open_ranks[k]["below"]].alias(f"k{i}") for i, k in enumerate(rest)]).first()
        found.update({k: picked[f"k{i}"] for i, k in enumerate(rest)})
    out = {}
    for n in names:
        if n not in ranks:
            out[n] = (0, None, None)
            continue
        low, high, share = ranks[n]
        a, b = found[targets[n][0], low], found[targets[n][0], high]
        out[n] = (*done[n], a + (b - a) * share)
    return out
