"""Exclusive percentiles with clamped ends, nearest ranks, and shares of a total, from value histograms rather than whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ranges import place

#: Percentiles of the view functions by name.
PERCENTILES = {"MEDIAN": 50.0, "P90": 90.0, "P95": 95.0, "P99": 99.0, "P999": 99.9}


#: Ranges of about equal size into which each group's values are cut, to sort only those that hold a sought rank.
CELLS = 256


def _same(a: DataFrame, b: DataFrame, names: list[str], suffix: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"{n}{suffix}"])
    return out


def _ranked(rows: DataFrame, keys: list[str], value: str, ranks: list[Column]) -> DataFrame:
    """keys, value, __upto and __n: how many values of the group are at most this one, and how many there are (nulls left out).

    Equal values are summed before the shuffle. Approximate quantiles cut each group's values into CELLS ranges, however they
    are spread; exact counts tell which ranges hold one of the ranks (of columns __n), and only their values are kept and
    sorted, so that a large group is not sorted in one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    bounds = F.percentile_approx(F.col(value).cast("double"), [k / CELLS for k in range(1, CELLS)], 4 * CELLS)
    spans = counted.groupBy(*[F.col(k).alias(f"{k}__s") for k in keys]).agg(F.array_distinct(bounds).alias("__bounds"), F.sum("__c").alias("__n"))
    cut = counted.join(spans, _same(counted, spans, keys, "__s")).drop(*[f"{k}__s" for k in keys])
    cut = cut.withColumn("__cell", place(F.col(value).cast("double"), F.col("__bounds"), CELLS)).drop("__bounds")
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut.groupBy(*keys, "__cell", "__n").agg(F.sum("__c").alias("__size")).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    holds = F.lit(False)
    for r in ranks:
        holds = holds | ((r >= F.col("__before")) & (r < F.col("__before") + F.col("__size")))
    cells = cells.where(holds).select(*[F.col(k).alias(f"{k}__t") for k in keys], F.col("__cell").alias("__cell__t"), "__before")
    kept = cut.join(cells, _same(cut, cells, [*keys, "__cell"], "__t"))
    within = Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return kept.select(*keys, value, "__n", (F.col("__before") + F.sum("__c").over(within)).alias("__upto"))


def _at(rank: Column, value: str, only: Column) -> Column:
    """Aggregate: the value of a 0-based rank among the rows that count."""
    return F.min(F.when(only & (F.col("__upto") > rank), F.col(value)))


def _exclusive(p: float) -> tuple[Column, Column, Column]:
    """The place of an exclusive percentile among __n values, clamped at the ends, and the ranks around it."""
    n = F.col("__n")
    place = F.greatest(F.lit(0.0), F.least(F.lit(p / 100) * (n + 1) - 1, n - 1.0))
    low = F.floor(place)
    return place, low, F.least(low + 1, n - 1)


def percentiles_exc(rows: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """One row a group with a column for each percentile p of each value column: wanted is {value: {name: p}}.

    All value columns are ranked in one pass, as rows (group, number of the column, value). A percentile is that of rank
    p / 100 * (n + 1), interpolated, clamped at the ends; null if the group's values are all null. Values are numbers.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(v).cast("double").alias("x")) for k, v in enumerate(wanted)]))
    long = rows.select(*keys, each.alias("__e")).select(*keys, F.col("__e.c").alias("__c__"), F.col("__e.x").alias("__x__"))
    out, ranks = [], []
    for k, (_, own) in enumerate(wanted.items()):
        mine = F.col("__c__") == k
        for name, p in own.items():
            at, low, high = _exclusive(p)
            ranks += [F.when(mine, low), F.when(mine, high)]
            a, b = _at(low, "__x__", mine), _at(high, "__x__", mine)
            out.append((a + F.max(F.when(mine, at - low)) * (b - a)).alias(name))
    ranks = [F.coalesce(r, F.lit(-1)) for r in ranks]
    return _ranked(long, [*keys, "__c__"], "__x__", ranks).groupBy(*keys).agg(*out)


def percentile_exc(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], whole: bool = False) -> DataFrame:
    """One row a group with a column for each wanted percentile p of one value (see percentiles_exc).

    whole: truncate to whole numbers (durations in nanoseconds). Groups whose values are all null have no row.
    """
    out = percentiles_exc(rows, keys, {value: wanted})
    return out.withColumns({n: F.col(n).cast("long") for n in wanted}) if whole else out


def nearest_rank(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, int]) -> DataFrame:
    """One row a group: the value of 0-based rank min(n - 1, n * p // 100) for each wanted whole percentile p."""
    within = keys or ["__all"]
    base = rows if keys else rows.withColumn("__all", F.lit(1))
    ranks = {name: F.least(F.col("__n") - 1, F.floor(F.col("__n") * p / 100)) for name, p in wanted.items()}
    return _ranked(base, within, value, list(ranks.values())).groupBy(*keys).agg(*[_at(r, value, F.lit(True)).alias(name) for name, r in ranks.items()])


def share_of_total(groups: DataFrame, column: str, to: str) -> DataFrame:
    """groups with each group's share of the column's sum over all groups (take it before any limit)."""
    total = groups.select(F.sum(column)).scalar()
    return groups.withColumn(to, F.col(column) / total)
