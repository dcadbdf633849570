"""Exact budget allocation over groups: a discretised budget, a tree of max-plus merges, an optional ROAS floor."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from campaignflow.functions.scalars import safe_ratio
from campaignflow.operators.curves import GROUP, marginal, response
from campaignflow.sources.workdir import checkpointed

#: Groups are numbered bucket by bucket, so that numbering needs no sort of all groups of a scenario in one task.
BUCKETS = 1024


def same(names) -> str:
    """Join condition on keys that may be null."""
    return " AND ".join(f"a.{n} <=> b.{n}" for n in names)


def numbered(groups: DataFrame, scenario: list[str]) -> DataFrame:
    """``groups`` with ``node``, counted from 0 without gaps in each scenario; the order follows a hash of the group's names."""
    place = groups.withColumn("bucket", F.pmod(F.xxhash64(*GROUP), F.lit(BUCKETS)).cast("int"))
    within = F.row_number().over(W.partitionBy(*scenario, "bucket").orderBy(*GROUP)) - 1
    # At most BUCKETS rows a scenario.
    sizes = place.groupBy(*scenario, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(*scenario).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*scenario, "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    return (
        place.withColumn("within", within).alias("a").join(offsets.alias("b"), F.expr(same([*scenario, "bucket"])))
        .select("a.*", (F.col("within") + F.col("offset")).cast("long").alias("node")).drop("bucket", "within"))


def merged(nodes: DataFrame, scenario: list[str], steps: int) -> DataFrame:
    """Neighbouring nodes joined: ``best[b]`` is the most revenue of ``b`` units split over both, ``right[b]`` the odd node's share.

    Of equal revenues the one with the larger share of the odd node counts. A node without a partner passes on.
    """
    pair = nodes.groupBy(*scenario, F.shiftright("node", 1).alias("parent")).agg(
        F.array_sort(F.collect_list(F.struct("node", "best"))).alias("two"))  # two rows at most
    one, other = F.col("two")[0]["best"], F.get("two", F.lit(1))["best"]
    top = F.least(F.size("one") + F.size("other") - 2, F.lit(steps))
    cells = F.transform(F.sequence(F.lit(0), top), lambda b: F.array_max(F.transform(
        F.sequence(F.greatest(b - F.size("one") + 1, F.lit(0)), F.least(b, F.size("other") - 1)),
        lambda k: F.struct((F.col("one")[b - k] + F.col("other")[k]).alias("v"), k.alias("k")))))
    rows = pair.select(*scenario, F.col("parent").alias("node"), one.alias("one"), other.alias("other"))
    rows = rows.withColumn("cells", F.when(F.col("other").isNotNull(), cells))
    return rows.select(*scenario, "node", F.coalesce(F.col("cells.v"), F.col("one")).alias("best"), F.col("cells.k").alias("right"))


def allocate(curves: DataFrame, budgets: DataFrame, scenario=("scenario",), steps: int = 200,
             max_scale: float = 4.0) -> DataFrame:
    """Split each scenario's daily budget over its groups for the most revenue.

    ``curves`` has one row per (scenario, channel, campaign_type) with the curve columns and
    ``historical_spend``; ``budgets`` has the scenario keys, ``total_budget`` and an optional ``roas_floor``.
    A group is a node that holds its best revenue for 0 to ``steps`` units. Nodes merge in pairs, round by round, until
    each scenario has one; every round is one shuffle of half as many nodes and keeps its choices in the shared folder.
    From the root's budget the choices are followed back down by joins. No row ever holds more than one node, so the work
    of a scenario spreads over as many tasks as it has groups. Scenarios without a positive budget have no rows.
    """
    scenario = list(scenario)
    budgets = budgets.where(F.col("total_budget") > 0)
    if "roas_floor" not in budgets.columns:
        budgets = budgets.withColumn("roas_floor", F.lit(None).cast("double"))
    budgets = budgets.select(*scenario, "total_budget", (F.col("total_budget") / steps).alias("step"), F.col("roas_floor").cast("double").alias("roas_floor"))
    own = [c for c in curves.columns if c not in {*scenario, "total_budget", "step", "roas_floor", "node"}]
    priced = curves.select(*scenario, *own).alias("a").join(budgets.alias("b"), F.expr(same(scenario))).select("a.*", "b.total_budget", "b.step", "b.roas_floor")
    limit = F.when(F.col("historical_spend") > 0, F.col("historical_spend") * max_scale).otherwise(F.col("total_budget"))
    cap = F.least(F.floor(limit / F.col("step") + 1e-9), F.lit(steps)).cast("int")
    leaves = checkpointed(numbered(priced, scenario))
    # The nodes are few beside their source: spread them over all tasks, since each costs up to steps x steps additions.
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = leaves.repartition(tasks, *scenario, "node").select(
        *scenario, "node", F.transform(F.sequence(F.lit(0), cap), lambda k: response(k * F.col("step"))).alias("best"))

    most = leaves.agg(F.max("node")).first()[0] or 0
    levels = []
    for _ in range(int(most).bit_length()):
        nodes = checkpointed(merged(nodes, scenario, steps))
        levels.append(nodes)

    spread = leaves.groupBy(*scenario).agg(F.sum(F.col("residual_std") * F.col("residual_std")).alias("spread"))
    roots = nodes.alias("a").join(budgets.alias("b"), F.expr(same(scenario))).select("a.*", "b.total_budget", "b.step", "b.roas_floor")
    roots = roots.alias("a").join(spread.alias("b"), F.expr(same(scenario))).select("a.*", "b.spread")
    full = F.size("best") - 1
    above = F.filter(F.sequence(F.lit(0), full), lambda b: (b > 0) & (F.col("best")[b] / (F.greatest(b, F.lit(1)) * F.col("step")) >= F.col("roas_floor")))
    roots = roots.withColumn("units", F.when(F.col("roas_floor").isNull(), full).otherwise(F.coalesce(F.array_max(above), F.lit(0))))
    spent, revenue, band = F.col("units") * F.col("step"), F.col("best")[F.col("units")], 0.6745 * F.sqrt("spread")
    plan = roots.select(
        *scenario, "node", "units", revenue.alias("predicted_revenue"),
        F.greatest(revenue - band, F.lit(0.0)).alias("predicted_low"), (revenue + band).alias("predicted_high"),
        F.coalesce(safe_ratio(revenue, spent), F.lit(0.0)).alias("blended_roas"), (F.col("total_budget") - spent).alias("unallocated"),
        (F.col("roas_floor").isNotNull() & (F.col("units") < full)).alias("floor_binding"))
    figures = plan.drop("node", "units")

    taken = plan.select(*scenario, "node", "units")
    for level in reversed(levels):
        chosen = taken.alias("a").join(level.alias("b"), F.expr(same([*scenario, "node"]))).select(
            *(F.col(f"a.{s}").alias(s) for s in scenario), F.col("a.node").alias("node"), "units", F.col("right")[F.col("units")].alias("share"))
        halves = F.when(F.col("share").isNull(), F.array(F.struct((F.col("node") * 2).alias("node"), F.col("units").alias("units")))).otherwise(F.array(
            F.struct((F.col("node") * 2).alias("node"), (F.col("units") - F.col("share")).alias("units")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.col("share").alias("units"))))
        taken = chosen.select(*scenario, F.explode(halves).alias("h")).select(*scenario, "h.node", "h.units")
    rows = leaves.alias("a").join(taken.alias("b"), F.expr(same([*scenario, "node"]))).select("a.*", "b.units")
    rows = rows.withColumn("allocation", F.col("units") * F.col("step")).alias("a").join(figures.alias("b"), F.expr(same(scenario)))
    return rows.select(
        *(F.col(f"a.{s}").alias(s) for s in scenario), *GROUP, "allocation", "historical_spend", marginal("allocation").alias("marginal_roas"),
        response("historical_spend").alias("current_revenue"), "total_budget",
        *(f"b.{c}" for c in ("predicted_revenue", "predicted_low", "predicted_high", "blended_roas", "unallocated", "floor_binding")))


def uplift(allocated: DataFrame, scenario=("scenario",), days: int = 30) -> DataFrame:
    """Per scenario: predicted against current daily revenue, their difference per day, over ``days`` days and in per cent."""
    totals = allocated.groupBy(*scenario).agg(
        F.max("predicted_revenue").alias("predicted_revenue"), F.sum("current_revenue").alias("current_revenue"),
        F.sum("allocation").alias("recommended_spend"), F.sum("historical_spend").alias("current_spend"))
    change = F.col("predicted_revenue") - F.col("current_revenue")
    return totals.withColumns({"daily_uplift": change, "period_uplift": change * days, "uplift_pct": 100 * safe_ratio(change, "current_revenue")})


def budget_moves(allocated: DataFrame, k: int = 6, scenario=("scenario",)) -> DataFrame:
    """The ``k`` largest changes of at least one unit per scenario."""
    order = W.partitionBy(*scenario).orderBy(F.abs("change").desc(), *GROUP)
    return (
        allocated.withColumn("change", F.col("allocation") - F.col("historical_spend"))
        .where(F.abs("change") >= 1.0)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
