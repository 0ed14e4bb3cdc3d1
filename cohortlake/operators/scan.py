"""Running values along chromosomes without a task per chromosome.

Rows are dealt into bins of positions; a window runs inside a bin, and a table of one row
per bin carries what earlier (or later) bins add up to. So the unit of work is a bin, and
the chromosome's order only rules over the small table of bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 1 << 20
BIN = "_bin"
_FOLD: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def binned(rows: DataFrame, at: str, width: int = WIDTH) -> DataFrame:
    return rows.withColumn(BIN, F.floor(F.col(at) / width))


def elsewhere(rows: DataFrame, by: list[str], order: list[str], how: str, value: Column, name: str, after: bool = False) -> DataFrame:
    """``rows`` (with bins) and as ``name`` the sum, max or min of ``value`` over all rows before, or ``after``, each row.

    ``order`` must begin with what the bins are made of. Without such rows a sum is 0, else null.
    """
    fold, join = _FOLD[how]
    frame = (1, Window.unboundedFollowing) if after else (Window.unboundedPreceding, -1)
    rows = rows.withColumn("_value", value)
    inside = fold("_value").over(Window.partitionBy(*by, BIN).orderBy(*order).rowsBetween(*frame))
    bins = rows.groupBy(*by, BIN).agg(fold("_value").alias("_whole"))
    bins = bins.withColumn("_carry", fold("_whole").over(Window.partitionBy(*by).orderBy(BIN).rowsBetween(*frame))).drop("_whole")
    out = rows.withColumn("_inside", inside).join(bins, [*by, BIN])
    return out.withColumn(name, join(F.col("_inside"), F.col("_carry"))).drop("_value", "_inside", "_carry")


def previous(rows: DataFrame, by: list[str], order: list[str], columns: list[str], name: str) -> DataFrame:
    """The row before each, as a struct of ``order`` and ``columns`` (null at the first): the greatest of all before."""
    return elsewhere(rows, by, order, "max", F.struct(*order, *[c for c in columns if c not in order]), name)


def with_halo(rows: DataFrame, at: str, before: int, after: int, width: int) -> DataFrame:
    """``rows`` copied into every bin that looks up to ``before`` back or ``after`` ahead at them; ``_own`` marks a row's own bin."""
    bins = F.array_distinct(F.array(F.floor(F.col(at) / width), F.floor((F.col(at) - after) / width), F.floor((F.col(at) + before) / width)))
    return rows.withColumn(BIN, F.explode(bins)).withColumn("_own", F.col(BIN) == F.floor(F.col(at) / width))


def sums_below(points: DataFrame, looks: DataFrame, by: list[str], at: str, values: list[str], width: int = WIDTH) -> DataFrame:
    """``looks`` with, for each of ``values`` (numbers of ``points``), its sum over the points of the same ``by`` that lie below ``at``.

    Points and look-ups of a bin meet in one window in order of place; what earlier bins
    hold comes from a table of one row per bin. A difference of two such sums is a sum
    over a span, whatever its length.
    """
    own = [c for c in looks.columns if c not in (*by, at)]
    rows = points.select(*by, at, F.lit(1).alias("_point"), *values).unionByName(looks.select(*by, at, F.lit(0).alias("_point"), *own), allowMissingColumns=True)
    rows = binned(rows, at, width)
    # a look-up comes before a point of the same place
    run = Window.partitionBy(*by, BIN).orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"_in_{v}": F.sum(v).over(run) for v in values}).where("_point = 0").drop(*values)
    bins = rows.groupBy(*by, BIN).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*by).orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(*by, BIN, *[F.sum(v).over(earlier).alias(f"_before_{v}") for v in values])
    none = F.lit(0)
    return inside.join(carried, [*by, BIN]).select(*by, at, *own, *[(F.coalesce(f"_in_{v}", none) + F.coalesce(f"_before_{v}", none)).alias(v) for v in values])


def running(steps: DataFrame, by: list[str], at: str, values: list[str], width: int = WIDTH) -> DataFrame:
    """by, at, each of ``values`` summed up to and with each step, and ``next``: where the next step is (null at the last). ``steps`` has one row per place."""
    rows = binned(steps.select(*by, at, *values), at, width)
    order = Window.partitionBy(*by, BIN).orderBy(at)
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"_in_{v}": F.sum(v).over(sofar) for v in values} | {"_next": F.lead(at).over(order)})
    bins = rows.groupBy(*by, BIN).agg(F.min(at).alias("_first"), *[F.sum(v).alias(v) for v in values])
    chain = Window.partitionBy(*by).orderBy(BIN)
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(*by, BIN, F.lead("_first").over(chain).alias("_later"), *[F.sum(v).over(earlier).alias(f"_before_{v}") for v in values])
    out = inside.join(carried, [*by, BIN])
    return out.select(*by, at, F.coalesce("_next", "_later").alias("next"), *[(F.col(f"_in_{v}") + F.coalesce(f"_before_{v}", F.lit(0))).alias(v) for v in values])
