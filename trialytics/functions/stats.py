"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialytics.functions.coerce import _c

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def wilson(passed: Column | str, total: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Score interval (low, high), within [0, 1]; (0, 0) for a total of 0."""
    k, n = _c(passed).cast("double"), _c(total).cast("double")
    p, scale = k / n, 1 + z * z / n
    centre, margin = (p + z * z / (2 * n)) / scale, z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / scale
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), centre + margin)).otherwise(0.0)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation of the rows that have both; null for fewer than 3 of them or a constant side."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    a, b = (F.when(both, _c(c).cast("double")) for c in (x, y))
    return F.when((F.count(a) >= 3) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def median(x: Column | str) -> Column:
    return F.percentile(_c(x), 0.5)


def fisher_exact(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """Two-sided p of a 2 x 2 table: all tables no likelier than the given one (within 1e-12).

    Each table's likelihood follows from its neighbour's by a ratio of four counts. They are
    summed outward from the likeliest table, relative to it, as far as 12 standard deviations and
    100 tables, beyond which all are below 1e-30; their sum is the scale, so that no factorial is
    needed. Work and memory grow with the square root of the counts.
    """
    a, b, c, d = (_c(x).cast("bigint") for x in (a, b, c, d))
    row, column, total, shift = a + b, a + c, a + b + c + d, d - a
    low, high = F.greatest(F.lit(0).cast("bigint"), -shift), F.least(row, column)
    real = lambda x: x.cast("double")
    middle = F.least(high, F.greatest(low, F.floor((real(row) + 1) * (real(column) + 1) / (real(total) + 2))))
    spread = F.sqrt(real(row) * real(column) / F.greatest(real(total), F.lit(1.0)) * real(total - row) / F.greatest(real(total), F.lit(1.0)) * real(total - column) / F.greatest(real(total) - 1, F.lit(1.0)))
    reach = F.ceil(12 * spread) + 100
    none = F.array().cast("array<bigint>")
    first, last = F.greatest(low, middle - reach), F.least(high, middle + reach)
    sides = (
        (F.when(last > middle, F.sequence(middle + 1, last)).otherwise(none), lambda x: real(row - x + 1) / real(x) * (real(column - x + 1) / real(x + shift))),
        (F.when(first < middle, F.sequence(middle - 1, first, F.lit(-1).cast("bigint"))).otherwise(none), lambda x: real(x + 1) / real(row - x) * (real(x + 1 + shift) / real(column - x))),
    )

    def summed(wanted, names: tuple[str, ...]) -> list[Column]:
        """Sums over both sides of wanted(relative likelihood, place), and the middle's own."""
        start = F.struct(F.lit(1.0).alias("r"), *(F.lit(0.0).alias(n) for n in names))

        def step(ratio):
            def taken(s: Column, x: Column) -> Column:
                r = s["r"] * ratio(x)
                return F.struct(r.alias("r"), *((s[n] + v).alias(n) for n, v in zip(names, wanted(r, x), strict=True)))

            return taken

        own, made = wanted(F.lit(1.0), middle), [F.aggregate(places, start, step(ratio)) for places, ratio in sides]
        return [own[i] + made[0][n] + made[1][n] for i, n in enumerate(names)]

    # arrays of one: what the sums are compared with is worked out once
    scale = F.array(F.struct(*(x.alias(n) for x, n in zip(summed(lambda r, x: (r, F.when(x == a, r).otherwise(0.0)), ("all", "given")), ("all", "given"), strict=True))))
    p = F.transform(scale, lambda t: summed(lambda r, x: (F.when(r <= t["given"] + t["all"] * 1e-12, r).otherwise(0.0),), ("no_likelier",))[0] / t["all"])
    return F.when(total.isNotNull(), F.least(F.lit(1.0), F.get(p, F.lit(0))))
