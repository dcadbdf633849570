"""Raw vendor columns to canonical fields: exact aliases first, then the best one-to-one fuzzy match."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignflow.functions.scalars import col
from campaignflow.functions.text_match import name_score
from campaignflow.schema import ALIASES, FUZZY_OPTIONAL_SCORE, FUZZY_REQUIRED_SCORE, REQUIRED

# ``channel`` is free text with its own fallback, so names alone never assign it.
FUZZY_FIELDS = [f for f in ALIASES if f != "channel"]
THRESHOLDS = {f: FUZZY_REQUIRED_SCORE if f in REQUIRED else FUZZY_OPTIONAL_SCORE for f in FUZZY_FIELDS}


def plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def normalised(name) -> Column:
    return F.regexp_replace(F.lower(col(name)), "[^a-z0-9]", "")


def alias_lookup(name) -> Column:
    """Canonical field of a raw name whose normalised form is an alias, else NULL."""
    pairs = {plain(a): field for field, aliases in ALIASES.items() for a in aliases}
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[normalised(name)]


def exact_mapping(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows (source, pos, raw_col) with ``field`` set on the first column to claim each alias."""
    found = catalogue.withColumn("alias", alias_lookup("raw_col"))
    claims = W.partitionBy("source", "alias").orderBy("pos")
    first = F.col("alias").isNotNull() & (F.row_number().over(claims) == 1)
    return found.withColumn("field", F.when(first, F.col("alias"))).drop("alias")


def _score_names(names: pd.Series) -> pd.Series:
    """Best alias score of each name for every field of ``FUZZY_FIELDS``."""
    pools = [[plain(a) for a in ALIASES[f]] for f in FUZZY_FIELDS]
    known = {n: [max(name_score(n, a) for a in pool) for pool in pools] for n in names.unique()}
    return names.map(known)


def best_assignment(scores: np.ndarray, valid: np.ndarray) -> list[int]:
    """Field per column (-1 for none): most acceptable pairs, then the highest total score.

    ``best[mask]`` is the value of assigning the columns seen so far to exactly the fields in ``mask``;
    with at most 12 fields that is 4096 states per column.
    """
    n_fields = scores.shape[1]
    masks = np.arange(1 << n_fields)
    best = np.full(1 << n_fields, -np.inf)
    best[0] = 0.0
    picks = []
    for row, ok in zip(scores, valid):
        nxt, pick = best.copy(), np.full(1 << n_fields, -1)
        for f in np.flatnonzero(ok):
            free = masks[(masks >> f) & 1 == 0]
            gain = best[free] + 1e6 + row[f]
            target = free | (1 << f)
            better = gain > nxt[target]
            nxt[target[better]], pick[target[better]] = gain[better], f
        best = nxt
        picks.append(pick)
    mask, out = int(np.argmax(best)), [-1] * len(picks)
    for i in range(len(picks) - 1, -1, -1):
        f = picks[i][mask]
        if f >= 0:
            out[i], mask = int(f), mask & ~(1 << int(f))
    return out


def _assign_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Settle one file's unmatched columns; a file has as many rows as columns."""
    rows = rows.sort_values("pos").reset_index(drop=True)
    claimed = set(rows["field"].dropna())
    fields = [f for f in FUZZY_FIELDS if f not in claimed]
    rows["method"] = np.where(rows["field"].notna(), "exact", "ignored")
    rows["score"], rows["nearest_field"] = np.nan, None
    open_rows = rows.index[rows["field"].isna()]
    if fields and len(open_rows):
        at = [FUZZY_FIELDS.index(f) for f in fields]
        scores = np.array([np.asarray(rows.at[i, "scores"])[at] for i in open_rows])
        valid = scores >= np.array([THRESHOLDS[f] for f in fields])
        for i, f, line in zip(open_rows, best_assignment(scores, valid), scores):
            j = f if f >= 0 else int(line.argmax())
            rows.at[i, "score"], rows.at[i, "nearest_field"] = round(float(line[j]), 1), fields[j]
            if f >= 0:
                rows.at[i, "field"], rows.at[i, "method"] = fields[f], "fuzzy"
    return rows[["source", "pos", "raw_col", "field", "method", "score", "nearest_field"]]


def map_columns(catalogue: DataFrame) -> DataFrame:
    """Field, method, score and nearest miss for every raw column of every source.

    Sources are settled independently, each in its own group of at most a few hundred header cells.
    """
    fuzzy_scores = F.pandas_udf(_score_names, T.ArrayType(T.DoubleType()))
    exact = exact_mapping(catalogue).withColumn("scores", fuzzy_scores(normalised("raw_col")))
    return exact.groupBy("source").applyInPandas(
        _assign_source,
        "source string, pos int, raw_col string, field string, method string, score double, nearest_field string")
