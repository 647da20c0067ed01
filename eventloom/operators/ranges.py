"""Windows over ordered rows in ranges, so that no task needs all rows of a key: previous values, running sums, k-th values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a range holds at most, or so; and rows for which it is not worth to cut one, as long as there are free cores.
ROWS, FEW = 1_000_000, 25_000


def same(a: DataFrame, b: DataFrame, names: list[str], suffix: str) -> Column:
    """Equality of columns, null to null, with those of b under a suffix."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[f"{n}{suffix}"])
    return out


def number(rows: DataFrame, column: str) -> Column:
    """A column of times or numbers as a number in the same order; times in microseconds."""
    kind = dict(rows.dtypes)[column]
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double") if kind.startswith("timestamp") else F.col(column).cast("double")


def how_many(spark: SparkSession, rows: int) -> int:
    """Into how many ranges so many rows are cut: in proportion to them, and as many as there are cores if rows suffice."""
    return max(1, -(-rows // ROWS), min(spark.sparkContext.defaultParallelism, rows // FEW))


def cuts(numbers: DataFrame) -> list[float]:
    """Where the numbers (one column of doubles) are cut into ranges of about equal size: the first number of each but the first range.

    Bounds are quantiles, so that outlying times leave the other ranges as they are. The driver sees one number a range.
    """
    (name,) = numbers.columns
    n = how_many(numbers.sparkSession, numbers.count())
    if n == 1:
        return []
    return sorted(set(numbers.approxQuantile(name, [k / n for k in range(1, n)], 0.2 / n)))


def place(x: Column, bounds: list[float] | Column, size: int | None = None) -> Column:
    """How many of the ascending bounds are at most x, by bisection; -1 for null."""
    if isinstance(bounds, list):
        size = len(bounds)
        if not size:
            return F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0))
        bounds = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")  # folded to a constant
    steps = F.lit([1 << k for k in reversed(range(int(size or 1).bit_length()))])
    step = lambda at, wide: F.when(F.try_element_at(bounds, at + wide) <= x, at + wide).otherwise(at)
    return F.when(x.isNull(), F.lit(-1)).otherwise(F.aggregate(steps, F.lit(0), step))


def in_ranges(rows: DataFrame, order: str) -> DataFrame:
    """rows with __slot: the range of the first order column; rows without it come first."""
    at = number(rows, order)
    return rows.withColumn("__slot", place(at, cuts(rows.select(at.alias("x")))))


def _edges(rows: DataFrame, keys: list[str], edge: Column, over: Callable[[Column], Column]) -> DataFrame:
    """Of each key and range, what the ranges before hold: the aggregate `edge` of each, then `over` all before; and their number."""
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*keys, "__slot").agg(edge.alias("__edge"))
    return each.select(*[F.col(k).alias(f"{k}__e") for k in keys], F.col("__slot").alias("__slot__e"), over(F.col("__edge")).over(before).alias("__edge"), F.count(F.lit(1)).over(before).alias("__ranges"))


def with_previous(rows: DataFrame, keys: list[str], value: Column, order: list[str], to: str = "__last", first: str = "__first") -> DataFrame:
    """rows with `to`: the value of the same key's row before, and `first`: whether there is none.

    Each key's rows are sorted in ranges of the first order column; a range's first row takes the last value of the nearest range
    before, of which a key has one row each. Rows of one and the same first order column are in one range.
    """
    names = rows.columns
    cut = in_ranges(rows.withColumn("__now", value), order[0])
    w = Window.partitionBy(*keys, "__slot").orderBy(*order)
    edges = _edges(cut, keys, F.max_by(F.struct("__now"), F.struct(*order)), lambda c: F.last(c))
    marked = cut.withColumns({"__in": F.row_number().over(w), "__lag": F.lag("__now").over(w)})
    both = marked.join(edges, same(marked, edges, [*keys, "__slot"], "__e"))
    start = F.col("__in") == 1
    return both.select(*[F.col(c) for c in names], F.when(start, F.col("__edge.__now")).otherwise(F.col("__lag")).alias(to), (start & (F.col("__ranges") == 0)).alias(first))


def with_running_sum(rows: DataFrame, keys: list[str], value: Column, order: list[str], to: str) -> DataFrame:
    """rows with `to`: the sum of the value over the same key's rows up to this one."""
    names = [c for c in rows.columns if c != to]
    cut = in_ranges(rows.withColumn("__now", value), order[0])
    w = Window.partitionBy(*keys, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    edges = _edges(cut, keys, F.sum("__now"), lambda c: F.sum(c))
    marked = cut.withColumn("__sum", F.sum("__now").over(w))
    both = marked.join(edges, same(marked, edges, [*keys, "__slot"], "__e"))
    return both.select(*[F.col(c) for c in names], (F.col("__sum") + F.coalesce("__edge", F.lit(0))).alias(to))


def kth(rows: DataFrame, column: str, k: int, cells: int = 1024) -> tuple[int, int]:
    """The whole number of 0-based rank k in a column without nulls, and how many are below it.

    Counts by ranges narrow it down: each pass brings at most `cells` counts to the driver.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    below = 0
    while low < high:
        width = -(-(high - low + 1) // cells)
        cell = F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("int")
        counts = rows.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect()
        for c, n in counts:
            if below + n > k:
                low, high = low + c * width, min(high, low + (c + 1) * width - 1)
                break
            below += n
    return low, below
