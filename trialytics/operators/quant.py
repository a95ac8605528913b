"""Numeric metrics against a binary outcome."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialytics.functions.stats import fisher_exact


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    """Null-safe equality of both sides' columns."""
    return reduce(Column.__and__, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))


#: Values that part a column into ranges: the steps of a search among them, the largest first.
STEPS = tuple(1 << i for i in reversed(range(10)))


def _with_range(counted: DataFrame, value: str, *groups: str) -> DataFrame:
    """counted with _range, the number of the value's range, rising with the value. The bounds are the values of those cells whose hashes are least: a sample that is the same in any order of rows and tasks."""
    chosen = counted.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.xxhash64(*groups, value).alias("h")).orderBy("h", "v").limit(2 * STEPS[0] - 1)
    bounded = counted.withColumn("_bounds", chosen.agg(F.array_sort(F.collect_list("v"))).scalar())
    further = lambda at, step: F.when(F.coalesce(F.get("_bounds", at + step - 1) < F.col(value), F.lit(False)), at + step).otherwise(at)
    return bounded.withColumn("_range", F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), further)).drop("_bounds")


def prefix_counts(counted: DataFrame, value: str, *groups: str, counts: Sequence[str] = ("n",), means: bool = False) -> DataFrame:
    """counted with, for each of its counts c, c_below (its sum over lower values of the group) and c_of (over the group); means: also c_mean, the mean value by c.

    counted: a row a group and value. Prefix counts over ranges of the distinct values: no task
    holds more than a range, however few the groups are. Only the ranges' totals, a row for each
    range and group, meet by group.
    """
    ranged = _with_range(counted, value, *groups)
    inside = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ahead, whole = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups)
    products = [F.sum(F.col(value) * F.col(c)).alias(f"_{c}_product") for c in counts if means]
    totals = ranged.groupBy(*groups, "_range").agg(*(F.sum(c).alias(f"_{c}_sum") for c in counts), *products)
    totals = totals.withColumns({f"_{c}_ahead": F.coalesce(F.sum(f"_{c}_sum").over(ahead),
        F.lit(0)) for c in counts} | {f"{c}_of": F.sum(f"_{c}_sum").over(whole) for c in counts} | ({f"{c}_mean": F.try_divide(F.sum(f"_{c}_product").over(whole),
        F.sum(f"_{c}_sum").over(whole)) for c in counts} if means else {}))
    local = ranged.withColumns({f"_{c}_inside": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts})
    joined = local.alias("l").join(totals.alias("t"), _same("l", "t", ["_range", *groups]))
    made = [x for c in counts for x in ((F.col(f"_{c}_ahead") + F.col(f"_{c}_inside")).alias(f"{c}_below"), F.col(f"t.{c}_of"), *([F.col(f"t.{c}_mean")] if means else []))]
    return joined.select(*(F.col(f"l.{c}") for c in counted.columns), *made)


def value_ranks(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """groups, value, n (rows of the value), below (rows of lower values in the group), of (rows of the group)."""
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("n"))
    return prefix_counts(counted, value, *groups).withColumnsRenamed({"n_below": "below", "n_of": "of"})


def _mean_place() -> Column:
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def average_rank(df: DataFrame, value: str, *groups: str, name: str = "avg_rank") -> DataFrame:
    """Rank within groups, ties at the mean of their places."""
    places = value_ranks(df, value, *groups).withColumn("_place", _mean_place())
    joined = df.alias("d").join(places.alias("p"), _same("d", "p", [*groups, value]))
    return joined.select("d.*", F.col("p._place").alias(name))


def metrics_by_outcome(df: DataFrame, metrics: Sequence[str], passed: Column) -> DataFrame:
    """One row a metric: n, means and medians by outcome, point-biserial r and Spearman rho.

    The metrics are unpivoted and counted by value and outcome; all else comes from those counts
    and their prefix sums (prefix_counts), so that no task holds a metric's rows or values. Both
    coefficients are sums of centred products: the means are known before they are taken.
    """
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    long = df.select(F.explode(pairs).alias("p"), passed.alias("outcome")).select("p.metric", "p.value", "outcome").where("value is not null and outcome is not null")
    counted = long.groupBy("metric", "value").agg(F.count_if(~F.col("outcome")).alias("f"), F.count_if("outcome").alias("p"))
    rows = prefix_counts(counted, "value", "metric", counts=("f", "p"), means=True)
    c, v = F.col, F.col("value")
    n, share = c("f_of") + c("p_of"), c("p_of") / (c("f_of") + c("p_of"))
    total = lambda x: F.coalesce(c(f"{x}_mean") * c(f"{x}_of"), F.lit(0.0))
    middle = (n + 1) / F.lit(2.0)
    rows = rows.withColumns({
        "_v": v - (total("f") + total("p")) / n, "_rank": c("f_below") + c("p_below") + (c("f") + c("p") + 1) / F.lit(2.0) - middle,
        "_o": c("p") * (1 - share) - c("f") * share, "_place": c("p") * (c("f_of") + (c("p_of") + 1) / F.lit(2.0) - middle) + c("f") * ((c("f_of") + 1) / F.lit(2.0) - middle),
    })
    weight = c("f") + c("p")
    # of an outcome's own two values, centred: n p (1 - p) as they are, and as ranks (the distance of the ranks is n / 2)
    spread = F.max(n * share * (1 - share))
    ok = (F.max(n) >= 3) & (F.min(v) < F.max(v)) & (spread > 0)
    r = F.when(ok, F.sum(c("_v") * c("_o")) / F.sqrt(F.sum(c("_v") * c("_v") * weight)) / F.sqrt(spread))
    rho = F.when(ok, F.sum(c("_rank") * c("_place")) / F.sqrt(F.sum(c("_rank") * c("_rank") * weight)) / F.sqrt(spread * F.max(n) * F.max(n) / 4))

    def median(x: str) -> Column:
        covers = lambda place: (c(f"{x}_below") < place) & (place <= c(f"{x}_below") + c(x))
        at = lambda place: F.max(F.when(covers(place), v))
        return (at(F.floor((c(f"{x}_of") + 1) / 2)) + at(F.floor(c(f"{x}_of") / 2) + 1)) / 2

    return rows.groupBy("metric").agg(F.max(n).alias("n"), F.max("p_mean").alias("pass_mean"), median("p").alias("pass_median"), F.max("f_mean").alias("fail_mean"), median("f").alias("fail_median"), r.alias("point_biserial"), rho.alias("spearman"))


def spearman(df: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """Pearson of average ranks by group; null for fewer than 3 rows. From the counts of distinct (x, y) and the ranks of distinct values, which are centred by their known mean."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(*groups, x, y).agg(F.count("*").alias("_w"))
    for side, name in ((x, "_rx"), (y, "_ry")):
        # a rank less its mean, (of + 1) / 2
        places = value_ranks(both, side, *groups).withColumn(name, _mean_place() - (F.col("of") + 1) / F.lit(2.0))
        cells = cells.alias("c").join(places.alias("p"), _same("c", "p", [*groups, side])).select("c.*", f"p.{name}")
    of = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("_w"))
    spread = of("_rx", "_rx") * of("_ry", "_ry")
    rho = F.when((F.sum("_w") >= 3) & (spread > 0), of("_rx", "_ry") / F.sqrt(of("_rx", "_rx")) / F.sqrt(of("_ry", "_ry")))
    return cells.groupBy(*groups).agg(F.sum("_w").alias("n"), rho.alias("spearman"))


def two_by_two(df: DataFrame, group: Column, first: str, second: str, passed: Column, n: str | None = None) -> DataFrame:
    """Counts and Fisher's exact p of two groups' outcomes; no row unless both groups occur. n: a column that says for how many rows a row stands."""
    held = lambda condition: F.count_if(condition) if n is None else F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0))
    table = df.groupBy().agg(*(held((group == g) & ok).alias(name) for g, name, ok in ((first, "a", passed), (first, "b", ~passed), (second, "c", passed), (second, "d", ~passed))))
    return table.where("a + b > 0 and c + d > 0").withColumn("fisher_p", fisher_exact("a", "b", "c", "d"))
