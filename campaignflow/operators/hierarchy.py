"""Campaign -> type -> channel -> total: coherent totals, residual bands, tree reconciliation, calibration."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignflow.functions.metrics import coverage
from campaignflow.functions.quantiles import pin_median, sort_row
from campaignflow.functions.scalars import col, safe_ratio
from campaignflow.schema import BANDS, QUANTILE_COLUMNS, QUANTILES, quantile_column
from campaignflow.sources.workdir import stored

TREE = ["channel", "campaign_type", "campaign_id"]
LEVELS = ["total", "channel", "campaign_type", "campaign"]
MIDDLE = QUANTILES.index(0.5)


def node_id(keys=TREE) -> Column:
    """``total/channel/type/campaign`` cut at the first missing key."""
    return F.concat_ws("/", F.lit("total"), *keys)


def node_columns(keys=TREE, levels=LEVELS) -> dict[str, Column]:
    """Node id, level name, parent id and leaf label from the tree keys of a rolled-up row."""
    depth = sum(F.col(k).isNotNull().cast("int") for k in keys)
    name = F.lit(levels[0])
    for i, level in enumerate(levels[1:], 1):
        name = F.when(depth == i, level).otherwise(name)
    ident = node_id(keys)
    return {
        "node_id": ident,
        "level": name,
        "parent_id": F.when(depth == 0, "").otherwise(F.regexp_replace(ident, "/[^/]*$", "")),
        "label": F.when(depth == 0, "Total").otherwise(F.element_at(F.split(F.element_at(F.split(ident, "/"), -1), "::"), -1)),
    }


def rollup_tree(leaves: DataFrame, aggregates, by=(), keys=TREE, levels=LEVELS) -> DataFrame:
    """Aggregate leaves to every node of the tree in one grouping-sets pass, partially combined before the shuffle."""
    by = list(by)
    sets = [[*by, *keys[:depth]] for depth in range(len(keys) + 1)]
    rolled = leaves.groupingSets([[F.col(c) for c in s] for s in sets], *by, *keys).agg(*aggregates)
    return rolled.withColumns(node_columns(keys, levels))


def node_series(history: DataFrame, by=("horizon_days",)) -> DataFrame:
    """Actual and model revenue per node and date, in one pass over the out-of-fold rows."""
    complete = history.dropna(subset=["target_revenue", "prediction"])
    return rollup_tree(complete, [F.sum("target_revenue").alias("y"), F.sum("prediction").alias("model")],
                       by=[*by, "origin_date"])


def aligned_dates(series: DataFrame, by=("horizon_days",)) -> DataFrame:
    """Dates on which every channel has a value: the joint tier calibrates on these only."""
    channels = series.where(F.col("level") == "channel")
    expected = channels.groupBy(*by).agg(F.count_distinct("node_id").alias("n_channels"))
    present = channels.groupBy(*by, "origin_date").agg(F.count(F.lit(1)).alias("n_present"))
    return present.join(expected, list(by)).withColumn("aligned", F.col("n_present") == F.col("n_channels"))


def residual_offsets(series: DataFrame, by=("horizon_days",), min_obs: int = 15) -> DataFrame:
    """Per node: quantiles of actual minus model, centred on their own median.

    Total and channel use the jointly observed dates, lower levels their own history and at least ``min_obs``
    dates. A node has one residual per date, so the exact percentile's state is bounded by the calendar.
    """
    by = list(by)
    joint = aligned_dates(series, by).where("aligned").select(*by, "origin_date", F.lit(True).alias("joint"))
    upper = F.col("level").isin("total", "channel")
    levels = F.array(*[F.lit(q) for q in QUANTILES])
    resid = F.when(~upper | F.col("joint"), F.col("y") - F.col("model"))
    per_node = (
        series.join(joint, [*by, "origin_date"], "left")
        .withColumn("resid", resid)
        .groupBy(*by, "node_id", "level")
        .agg(F.count("resid").alias("n_obs"), F.percentile("resid", levels).alias("q"))
    )
    usable = F.when(upper, F.col("n_obs") > 0).otherwise(F.col("n_obs") >= min_obs)
    method = F.when(usable & upper, "joint_conformal").when(usable, "marginal_conformal").otherwise("rescaled_sum")
    return per_node.select(
        *by, "node_id", "level", "n_obs", method.alias("method"),
        *[F.when(usable, F.col("q")[i] - F.col("q")[MIDDLE]).alias(f"off_{c}") for i, c in enumerate(QUANTILE_COLUMNS)])


def reconcile(live: DataFrame, history: DataFrame, by=("horizon_days",), snapshot=()) -> DataFrame:
    """Coherent quantiles and ROAS ranges for every node known to the history or the forecast.

    ``live`` has one row per campaign (per ``by`` and ``snapshot`` keys) with the quantile columns and spend.
    A historical campaign without a live row counts as 0; one without history has the band of its own forecast. The median is the plain sum up the tree (which is
    already coherent, so a projection of it changes nothing); the band is the median plus the node's residual
    offsets, or the sorted sum of quantiles where the history is too short.
    """
    by, snapshot = list(by), list(snapshot)
    has_spend = "spend" in live.columns
    values = [*QUANTILE_COLUMNS, *(["spend"] if has_spend else [])]
    keys = [*by, *snapshot, *TREE]
    padded = live.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in values])
    if not snapshot:
        # Campaigns that only the history knows still have a node; among snapshots a missing row adds nothing.
        known = history.dropna(subset=["target_revenue", "prediction"]).select(*by, *TREE).distinct()
        padded = padded.join(known, keys, "full").select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in values])
    nodes = rollup_tree(padded, [F.sum(c).alias(c) for c in values], by=[*by, *snapshot])
    nodes = nodes.withColumn("reconciled_median", F.col(quantile_column(0.5)))
    offsets = residual_offsets(node_series(history, by), by)
    joined = nodes.join(offsets.drop("level"), [*by, "node_id"], "left")

    shifted = pin_median([F.col("reconciled_median") + F.col(f"off_{c}") for c in QUANTILE_COLUMNS], MIDDLE)
    summed = sort_row(QUANTILE_COLUMNS)
    banded = F.col("method").isin("joint_conformal", "marginal_conformal")
    out = joined.select(
        *by, *snapshot, "node_id", "parent_id", "label", "level",
        F.coalesce("method", F.lit("rescaled_sum")).alias("method"), F.coalesce("n_obs", F.lit(0)).alias("n_obs"),
        "reconciled_median",
        *[F.when(banded, s).otherwise(n).alias(c) for c, s, n in zip(QUANTILE_COLUMNS, shifted, summed)],
        *(["spend"] if has_spend else []))
    if has_spend:
        out = out.withColumns({f"roas_{c}": safe_ratio(c, "spend") for c in [*QUANTILE_COLUMNS, "reconciled_median"]})
    return out


def coherence_error(nodes: DataFrame, value: str = "reconciled_median", by=("horizon_days",)) -> DataFrame:
    """Largest gap between a node and the sum of its children."""
    by = list(by)
    children = nodes.where(F.col("parent_id") != "").groupBy(*by, F.col("parent_id").alias("node_id")).agg(
        F.sum(value).alias("child_sum"))
    return (
        nodes.join(children, [*by, "node_id"])
        .groupBy(*by)
        .agg(F.max(F.abs(F.col(value) - F.col("child_sum"))).alias("max_abs_error"), F.count(F.lit(1)).alias("n_parents"))
    )


def calibration_by_level(live: DataFrame, history: DataFrame) -> DataFrame:
    """Coverage of the reconciled bands per level over all (horizon, origin date) snapshots, in one job."""
    at = ["horizon_days", "origin_date"]
    bands = reconcile(live.drop("spend"), history, snapshot=["origin_date"])
    actual = rollup_tree(live, [F.sum("target_revenue").alias("y")], by=at)
    joined = actual.select(*at, "node_id", "y").join(bands, [*at, "node_id"])
    cover = [coverage("y", quantile_column(lo), quantile_column(hi)).alias(f"coverage_{label[:-1]}")
             for lo, hi, _, label in BANDS]
    return joined.groupBy("level").agg(F.count(F.lit(1)).alias("n_observations"), *cover)


def wls_reconcile(nodes: DataFrame, by=(), forecast="forecast", variance="variance",
                  keys=TREE, levels=LEVELS) -> DataFrame:
    """Weighted least-squares reconciliation of independent forecasts at every node of a strict tree.

    With a diagonal error variance the dense projection splits into one pass up (combine a node's own forecast
    with its children's total by precision) and one pass down (share the correction by variance). Each pass is
    one aggregation and one join per level, whatever the number of nodes.
    """
    by = list(by)
    base = nodes.select(*by, "node_id", "parent_id", "level", F.col(forecast).alias("f"), F.col(variance).alias("w"))
    leaf = base.where(F.col("level") == levels[-1]).select(
        *by, "node_id", "parent_id", "level", F.col("f").alias("m"), F.col("w").alias("v"),
        F.lit(None).cast("double").alias("child_m"), F.lit(None).cast("double").alias("child_v"))
    passes = [leaf]
    for level in reversed(levels[:-1]):
        children = passes[-1].groupBy(*by, F.col("parent_id").alias("node_id")).agg(
            F.sum("m").alias("child_m"), F.sum("v").alias("child_v"))
        precision = 1 / F.col("child_v") + 1 / F.col("w")
        passes.append(base.where(F.col("level") == level).join(children, [*by, "node_id"]).select(
            *by, "node_id", "parent_id", "level",
            ((F.col("child_m") / F.col("child_v") + F.col("f") / F.col("w")) / precision).alias("m"),
            (1 / precision).alias("v"), "child_m", "child_v"))
    passes.reverse()
    settled = [passes[0].select(*by, "node_id", "level", F.col("m").alias("reconciled"), "child_m", "child_v")]
    for lower in passes[1:]:
        above = settled[-1].select(
            *by, F.col("node_id").alias("parent_id"), ((F.col("reconciled") - F.col("child_m")) / F.col("child_v")).alias("share"))
        settled.append(lower.join(above, [*by, "parent_id"]).select(
            *by, "node_id", "level", (F.col("m") + F.col("v") * F.col("share")).alias("reconciled"), "child_m", "child_v"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.drop("child_m", "child_v")


def block_products(group: pa.Table, by: list[str]) -> pa.Table:
    """Two blocks of nodes: each pair's mean product of standardised residuals and the variance of these products."""
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    block, z = group.column("block").to_numpy(), group.column("z").to_numpy()
    day, date = np.unique(group.column("day").to_numpy(), return_inverse=True)
    n = len(day)
    sides = []
    for which in (low, high):
        names, place = np.unique(np.array(group.column("node_id").to_pylist(), object)[block == which].astype(str), return_inverse=True)
        dense = np.zeros((n, len(names)))
        dense[date[block == which], place] = z[block == which]
        sides.append((names, dense))
    (names_a, a), (names_b, b) = sides
    total = a.T @ b
    spread = ((a * a).T @ (b * b) - total * total / n) / max(1, n - 1)
    # Within one block each pair counts once.
    i, j = np.triu_indices(len(names_a), 1) if low == high else (x.ravel() for x in np.indices(total.shape))
    swap = names_a[i] > names_b[j]
    first, second = np.where(swap, names_b[j], names_a[i]), np.where(swap, names_a[i], names_b[j])
    fixed = {c: pa.array([group.column(c)[0].as_py()] * len(i), group.schema.field(c).type) for c in by}
    return pa.table({**fixed, "node_a": pa.array(first.tolist(), pa.string()), "node_b": pa.array(second.tolist(), pa.string()),
                     "corr": pa.array(total[i, j] / max(1, n - 1)), "spread": pa.array(spread[i, j])})


def residual_covariance(series: DataFrame, level: str = "channel", by=("horizon_days",), block: int = 256) -> DataFrame:
    """Shrunk residual covariance between all nodes of a level, over the dates on which every one of them has a residual.

    One row per pair and per node. The nodes are dealt to blocks; two blocks meet in one task as matrices of at most
    ``block`` nodes (on average) by the dates of the calendar. Off-diagonal entries shrink towards 0 by an intensity from
    the moments of the standardised products. A node whose residuals never vary has covariance 0 and no part in the
    intensity, which is 1 where no pair says anything. Without nodes there are no rows.
    """
    by = list(by)
    own = series.where(F.col("level") == level).select(*by, "origin_date", "node_id", (F.col("y") - F.col("model")).alias("r")).dropna(subset=["r"])
    expected = own.groupBy(*by).agg(F.count_distinct("node_id").alias("n_nodes"))
    full = own.groupBy(*by, "origin_date").agg(F.count(F.lit(1)).alias("n_present")).join(expected, by).where("n_present = n_nodes")
    # Read by the moments and by the pairs.
    aligned = stored(own.join(full.select(*by, "origin_date", "n_nodes"), [*by, "origin_date"]), "aligned")
    moments = aligned.groupBy(*by, "node_id").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    blocks = F.ceil(F.col("n_nodes") / block).cast("int")
    z = aligned.join(moments, [*by, "node_id"]).select(
        *by, "node_id", F.unix_date("origin_date").alias("day"), F.pmod(F.xxhash64("node_id"), blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"), F.coalesce((F.col("r") - F.col("m")) / F.nullif("s", F.lit(0.0)), F.lit(0.0)).alias("z"))
    met = z.select(*by, F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node_id", "day", "z")

    def products(group: pa.Table) -> pa.Table:
        return block_products(group, by)

    kinds = dict(series.dtypes)
    shape = ", ".join([*(f"{c} {kinds[c]}" for c in by), "node_a string, node_b string, corr double, spread double"])
    pairs = stored(met.groupBy(*by, "low", "high").applyInArrow(products, shape), "pairs")
    n_days = moments.groupBy(*by).agg(F.max("n").alias("n"))
    n = F.col("n")
    noise, signal = F.sum(F.col("spread") * n * n / F.pow(n - 1, F.lit(3.0))), F.sum(F.col("corr") * F.col("corr"))
    weights = pairs.join(n_days, by).groupBy(*by).agg((noise / F.nullif(signal, F.lit(0.0))).alias("ratio"))
    shrinkage = F.least(F.greatest(F.coalesce("ratio", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    shrunk = n_days.join(weights, by, "left").select(*by, "n", shrinkage.alias("shrinkage"))
    spread = {side: moments.select(*by, F.col("node_id").alias(f"node_{side}"), F.col("s").alias(f"s_{side}")) for side in ("a", "b")}
    off = pairs.join(spread["a"], [*by, "node_a"]).join(spread["b"], [*by, "node_b"]).select(*by, "node_a", "node_b", "corr", F.expr("s_a * s_b").alias("scale"))
    own_variance = moments.select(*by, F.col("node_id").alias("node_a"), F.col("node_id").alias("node_b"), F.lit(None).cast("double").alias("corr"), F.expr("s * s").alias("scale"))
    return off.unionByName(own_variance).join(shrunk, by).select(
        *by, "n", "shrinkage", "node_a", "node_b", F.when(F.col("corr").isNull(), F.col("scale")).otherwise((1 - F.col("shrinkage")) * F.col("corr") * F.col("scale")).alias("covariance"))


def share_of_parent(nodes: DataFrame, value: str, by=("horizon_days",)) -> DataFrame:
    """Each node's value over its parent's, floored at 0."""
    by = list(by)
    shown = F.greatest(col(value), F.lit(0.0))
    parents = nodes.select(*by, F.col("node_id").alias("parent_id"), shown.alias("parent_value"))
    return nodes.select(*by, "node_id", "parent_id", "label", "level", shown.alias("value")).join(
        parents, [*by, "parent_id"], "left").withColumn("share", safe_ratio("value", "parent_value"))
