"""Running aggregates over a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCHES = 512
ROWS_A_SHARE = 1 << 18


def _cuts(df: DataFrame, key: str, most: int) -> list:
    """At most ``most`` values that cut ``key`` into stretches of about equally many rows."""
    found = df.agg(F.percentile_approx(key, [i / most for i in range(1, most)], 10 * most)).first()[0] or []
    return sorted(set(found))


def running(df: DataFrame, order: list[str], value: Column, name: str, agg: str = "sum", by: list[str] | None = None, stretches: int | None = None, before: bool = True) -> DataFrame:
    """``df`` with ``name``: the sum or max of ``value`` over the rows before (``before``) or up to each row.

    ``order[0]`` is a number; rows are cut at its quantiles into ``stretches`` of about equally many rows (as many as there are
    shuffle partitions, ``STRETCHES`` at most). Only one figure of each stretch and group goes through an ordered window of its
    own, so that no task sees all rows, however the order's values lie; rows that share one value of ``order[0]`` stay
    together. Ties of ``order`` must be told apart by its later columns. Empty input gives an empty result; null values are left
    out; the first row has 0 (sum) or null (max).
    """
    by = by or []
    stretches = stretches or min(STRETCHES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = {"sum": F.sum, "max": F.max}[agg]
    cuts = _cuts(df, order[0], stretches) if stretches > 1 else []
    place = _searched(cuts, F.col(order[0]))
    cut = df.withColumns({"__cut": F.coalesce(place, F.lit(0)), "__value": value})
    stretch = cut.groupBy(*by, "__cut").agg(total("__value").alias("__part"))
    past = Window.partitionBy(*by).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    stretch = stretch.select(*by, "__cut", total("__part").over(past).alias("__past"))
    own = Window.partitionBy(*by, "__cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    within = cut.withColumn("__own", total("__value").over(own))
    out = within.join(stretch, [*by, "__cut"])
    both = F.coalesce(F.col("__past"), F.lit(0)) + F.coalesce(F.col("__own"), F.lit(0)) if agg == "sum" else F.greatest("__past", "__own")
    return out.select(*df.columns, both.alias(name))


def _searched(cuts: list, x: Column, low: int = 0, high: int | None = None) -> Column:
    """How many cuts are at or below ``x``: nested comparisons, as deep as the logarithm of their number."""
    high = len(cuts) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x >= F.lit(cuts[middle]), _searched(cuts, x, middle + 1, high)).otherwise(_searched(cuts, x, low, middle))


def numbered(df: DataFrame, keys: list[str], name: str, start: int = 0, shares: int | None = None) -> DataFrame:
    """``df`` with distinct numbers from ``start`` on, the same in every run. ``keys`` tell rows apart.

    Rows are dealt by hash into ``shares`` (else as many as keep each at about ``ROWS_A_SHARE`` rows, which are counted); one
    figure for each share goes through an ordered window.
    """
    shares = shares or max(1, -(-df.count() // ROWS_A_SHARE))
    dealt = df.withColumn("__share", F.pmod(F.xxhash64(*keys), F.lit(shares)))
    sizes = dealt.groupBy("__share").agg(F.count("*").alias("__size"))
    sizes = sizes.select("__share", F.coalesce(F.sum("__size").over(Window.orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__share").orderBy(*keys)) - 1
    return dealt.withColumn("__place", place).join(sizes, "__share").select(*df.columns, (F.col("__base") + F.col("__place") + start).alias(name))
