"""Views: what to select from which event types, with filters, grouping, order and limit, built as a DataFrame.

A view is written in Python rather than in a query text; anything beyond it is Spark SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import naming
from eventloom.functions.describe import plain_label
from eventloom.functions.formatting import FOREVER
from eventloom.functions.percentiles import PERCENTILES, percentiles_exc
from eventloom.operators.ranges import same
from eventloom.sources.catalog import Catalog

#: Paths into stack traces that are not stored: what they make of the frames.
FRAMES = {"topFrame": naming.top_frame, "topNotInitFrame": naming.top_ordinary_frame, "topApplicationFrame": naming.top_application_frame}
#: Types whose ids name event types, which are shown by their labels.
SETTINGS = ("ActiveSetting", "RecordingSetting")


@dataclass(frozen=True)
class Item:
    """A selected column: a field, or a function of it (`*` for rows), of one or several aliases, under a name."""

    name: str
    path: str
    function: str | None = None
    aliases: tuple[str, ...] = ()


def field(name: str, path: str | None = None, *aliases: str) -> Item:
    return Item(name, path or name, None, aliases)


def agg(name: str, function: str, path: str = "*", *aliases: str) -> Item:
    return Item(name, path, function.upper(), aliases)


@dataclass(frozen=True)
class Source:
    """An event type, with an alias if it is correlated with others, and equality filters of its own."""

    event_type: str
    alias: str | None = None
    where: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class View:
    select: tuple[Item, ...]
    sources: tuple[Source, ...]
    where: tuple[tuple[str, str], ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, str | None], ...] = ()
    limit: int | None = None
    #: Share of each value in its column's sum over all groups, before the limit: column -> new column.
    normalized: tuple[tuple[str, str], ...] = ()
    label: str = ""


#: Functions of a value column and the order of its rows: further ones can be registered.
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "SUM": lambda x, order: F.sum(x),
    "AVG": lambda x, order: F.avg(x),
    "MIN": lambda x, order: F.min(x),
    "MAX": lambda x, order: F.max(x),
    "FIRST": lambda x, order: F.min_by(x, order),
    "LAST": lambda x, order: F.max_by(x, order),
    "UNIQUE": lambda x, order: F.count_distinct(x),
    "SET": lambda x, order: F.array_sort(F.collect_set(x)),
}


def register_aggregate(name: str, build: Callable[[Column, Column], Column]) -> None:
    AGGREGATES[name.upper()] = build


def _difference(x: Column, order: Column, kind: T.DataType, rows: Column | None = None) -> Column:
    """Last less first value that is not null, by the order; times in microseconds, numbers truncated to whole ones."""
    there = x.isNotNull() if rows is None else x.isNotNull() & rows
    at = F.when(there, order)
    last, first = F.max_by(x, at), F.min_by(x, at)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return (last - first).cast("long")


class Rows:
    """Rows of one or several types and what paths mean in them."""

    def __init__(self, rows: DataFrame, catalog: Catalog):
        self.rows, self.catalog = rows, catalog

    def having(self, rows: DataFrame) -> Rows:
        return Rows(rows, self.catalog)

    def root(self, path: str) -> str:
        """The column that a path starts with."""
        first = path.split(".")[0]
        return first if first in self.rows.columns else self.catalog.renamed.get(first, first)

    def found(self, path: str) -> tuple[Column, T.DataType] | None:
        """A dotted path as a column with its type, or None if the rows have no such field.

        eventType, or its label or name, are those of the row's type. FRAMES lead into the frames of a stack trace.
        """
        first, *rest = path.split(".")
        if first == "eventType":
            column = {"": "__label", "label": "__label", "name": "__type"}.get(".".join(rest))
            return (F.col(column), T.StringType()) if column in self.rows.columns else None
        root = self.root(path)
        if root not in self.rows.columns:
            return None
        x, kind = F.col(f"`{root}`"), self.rows.schema[root].dataType
        for part in rest:
            if naming.has(kind, part):
                x, kind = x[part], kind[part].dataType
            elif part in FRAMES and naming.has(kind, "frames") and isinstance(kind["frames"].dataType, T.ArrayType):
                frame = kind["frames"].dataType.elementType
                if part != "topFrame" and not naming.has(frame, {"topNotInitFrame": "method.name", "topApplicationFrame": "method.type.name"}[part]):
                    return None
                x, kind = FRAMES[part](x["frames"]), frame
            else:
                return None
        return x, kind

    def column(self, path: str) -> Column:
        found = self.found(path)
        return F.lit(None) if found is None else found[0]

    def kind(self, path: str) -> T.DataType | None:
        found = self.found(path)
        return None if found is None else found[1]

    def shown(self, path: str) -> Column:
        """column(), but the ids of settings by the labels of the types that they name."""
        x, names = self.column(path), self.catalog.labels
        if path != "id" or "__type" not in self.rows.columns or not names or not isinstance(self.kind(path), T.StringType):
            return x
        labels = F.create_map(*[F.lit(y) for pair in names.items() for y in pair])
        is_setting = F.substring_index("__type", ".", -1).isin(*SETTINGS)
        return F.when(is_setting, F.coalesce(plain_label(labels[x]), x)).otherwise(x)

    def key(self, path: str) -> Column:
        """What a path is grouped by."""
        found = self.found(path)
        return F.lit(None) if found is None else naming.identity(*found)

    def is_duration(self, path: str) -> bool:
        return self.root(path).endswith("duration_ns") or self.root(path).endswith("Time_ns")


def _filtered(rows: DataFrame, where: tuple[tuple[str, str], ...], catalog: Catalog) -> DataFrame:
    for path, value in where:
        rows = rows.where(Rows(rows, catalog).column(path).cast("string") == value)
    return rows


def evaluate(view: View, catalog: Catalog) -> DataFrame:
    """The view's rows. Without an ORDER BY, grouped views come by their last column: numbers descending, texts ascending."""
    known = set(AGGREGATES) | set(PERCENTILES) | {"COUNT", "DIFF", "LAST_BATCH"}
    unknown = [i.function for i in view.select if i.function and i.function not in known]
    if unknown:
        raise ValueError(f"unknown functions {unknown}; there are {sorted(known)}")
    if any(s.alias for s in view.sources):
        out = _correlated(view, catalog)
    elif view.group_by or any(i.function for i in view.select):
        out = _grouped(view, Rows(_filtered(_union(view, catalog), view.where, catalog), catalog))
    else:
        rows = Rows(_filtered(_union(view, catalog), view.where, catalog), catalog)
        names = [n for n in rows.rows.columns if not n.startswith("__")]
        items = [F.col(n) for n in names] if [i.path for i in view.select] == ["*"] else [rows.shown(i.path).alias(i.name) for i in view.select]
        out = rows.rows.select(*items)
    for column, to in view.normalized:
        out = out.withColumn(to, F.col(column) / out.select(F.sum(column)).scalar())
    return _limited(_ordered(view, out), view.limit)


def _union(view: View, catalog: Catalog) -> DataFrame:
    """All types' rows; __fields names the fields that the row's type has, for counts over several types."""
    out = None
    for s in view.sources:
        rows = _filtered(catalog.marked(s.event_type), s.where, catalog)
        if len(view.sources) > 1:
            rows = rows.withColumn("__fields", F.array(*[F.lit(n) for n in rows.columns]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("a view needs an event type")
    return out


def _value(rows: Rows, item: Item, order: Column, several: bool) -> Column:
    x = rows.column(item.path) if item.path != "*" else F.lit(1)
    if item.function == "COUNT":
        return F.count(F.when(F.array_contains("__fields", rows.root(item.path)), 1)) if several and item.path != "*" else F.count(F.lit(1))
    if item.function == "DIFF":
        return _difference(x, order, rows.kind(item.path) or T.LongType())
    if item.function == "LAST_BATCH":
        return F.max_by(x, F.when(F.col("__in_last"), order))
    out = AGGREGATES[item.function](x, order)
    return F.floor(out + 0.5).cast("long") if item.function == "AVG" and rows.is_duration(item.path) else out


def _with_percentiles(out: DataFrame, rows: DataFrame, keys: list[str], ranked: dict[str, dict[str, float]], whole: set[str]) -> DataFrame:
    """out, a row for each group, with the percentiles of the groups' rows; those in `whole` are cut to whole numbers."""
    if not ranked:
        return out
    side = percentiles_exc(rows, keys, ranked)
    side = side.withColumns({n: F.col(n).cast("long") for n in whole}) if whole else side
    if not keys:
        return out.withColumns({name: side.select(name).scalar() for own in ranked.values() for name in own})
    side = side.withColumnsRenamed({k: f"{k}__p" for k in keys})
    return out.join(side, same(out, side, keys, "__p"), "left")


def _grouped(view: View, source: Rows) -> DataFrame:
    """One row a group. Fields beside functions are those of the group's first row; no input row gives no output row."""
    time, seq = source.catalog.order
    order = F.struct(time, seq)
    names = {i.name: i.path for i in view.select if not i.function}
    paths = [names.get(g, g) for g in view.group_by]
    keys = [f"__key{k}" for k in range(len(paths))]
    rows = source.rows.withColumns({k: source.key(p) for k, p in zip(keys, paths, strict=True)}) if keys else source.rows
    last_batch = any(i.function == "LAST_BATCH" for i in view.select)
    if last_batch:
        rows = rows.withColumn("__in_last", F.col(time) == rows.select(F.max(time)).scalar())
    source = source.having(rows)
    plain, ranked, values, whole = [], {}, {}, set()
    for k, item in enumerate(view.select):
        if item.function in PERCENTILES:
            x = values.setdefault(item.path, f"__x{len(values)}")
            ranked.setdefault(x, {})[f"__v{k}"] = PERCENTILES[item.function]
            whole |= {f"__v{k}"} if source.is_duration(item.path) else set()
        elif item.function:
            plain.append(_value(source, item, order, len(view.sources) > 1).alias(f"__v{k}"))
        else:
            at = F.when(F.col("__in_last"), order) if last_batch and item.path not in paths else order
            plain.append(F.min_by(source.shown(item.path), at).alias(f"__v{k}"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *([F.count_if("__in_last").alias("__last")] if last_batch else []), *plain)
    out = out.where("__n > 0" if not last_batch else "__last > 0")
    out = _with_percentiles(out, rows.withColumns({x: source.column(p).cast("double") for p, x in values.items()}), keys, ranked, whole)
    return out.select(*[F.col(f"__v{k}").alias(i.name) for k, i in enumerate(view.select)])


def _correlated(view: View, catalog: Catalog) -> DataFrame:
    """Aliases of types, correlated by equal group keys: a group of any alias gives a row (a full outer join by all keys).

    Each alias's rows are marked and grouped in one go, so that the number of aliases adds no shuffle. A field of an alias
    is that of its first row in the group; of several aliases, that of the first that has rows. DIFF over aliases is
    endless (FOREVER) if one of them has no row in the group. Percentiles are over the rows of the aliases.
    """
    time, seq = catalog.order
    order = F.struct(time, seq)
    rows, aliases = None, [s.alias or s.event_type for s in view.sources]
    for s, a in zip(view.sources, aliases, strict=True):
        mine = tuple((p.split(".", 1)[1], v) for p, v in view.where if p.split(".", 1)[0] == a)
        part = _filtered(catalog.marked(s.event_type), (*s.where, *mine), catalog).withColumn("__alias", F.lit(a))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    bare = [g.split(".", 1)[1] if g.split(".", 1)[0] in aliases else g for g in view.group_by]
    keys = [f"__key{k}" for k in range(len(bare))]
    last_batch = any(i.function == "LAST_BATCH" for i in view.select)
    if last_batch:  # of each alias its own
        latest = rows.groupBy("__alias").agg(F.max(time).alias("__latest"))
        rows = rows.join(F.broadcast(latest), "__alias").withColumn("__in_last", F.col(time) == F.col("__latest"))
    rows = rows.withColumns({k: Rows(rows, catalog).key(p) for k, p in zip(keys, bare, strict=True)})
    source = Rows(rows, catalog)
    is_of = lambda a: F.col("__alias") == a
    out, ranked, values, whole = [], {}, {}, set()
    for n, item in enumerate(view.select):
        mine, name = item.aliases or tuple(aliases), f"__v{n}"
        x = source.column(item.path) if item.path != "*" else F.lit(1)
        inside = F.col("__alias").isin(*mine)
        if not item.function:
            if item.path in bare and not item.aliases:
                out.append(F.min_by(source.shown(item.path), order).alias(name))
                continue
            pick = F.lit(None)
            for a in reversed(mine):
                pick = F.when(F.count_if(is_of(a)) > 0, F.min_by(source.shown(item.path), F.when(is_of(a), order))).otherwise(pick)
            out.append(pick.alias(name))
        elif item.function in PERCENTILES:
            column = values.setdefault((item.path, mine), f"__x{len(values)}")
            ranked.setdefault(column, {})[name] = PERCENTILES[item.function]
            whole |= {name} if source.is_duration(item.path) else set()
        elif item.function == "COUNT":
            out.append(F.count_if(inside).alias(name))
        elif item.function == "DIFF":
            kind = source.kind(item.path) or T.LongType()
            if len(mine) > 1 and item.aliases:
                # rows come alias by alias: from the first row of the first alias to the last row of the last one
                micros = lambda c: F.unix_micros(c.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c if isinstance(kind, T.LongType) else c.cast("double")  # noqa: B023, E731
                first = F.min_by(x, F.when(is_of(mine[0]) & x.isNotNull(), order))
                last = F.max_by(x, F.when(is_of(mine[-1]) & x.isNotNull(), order))
                lacking = F.lit(False)
                for a in mine:
                    lacking = lacking | (F.count_if(is_of(a)) == 0)
                out.append(F.when(lacking, F.lit(FOREVER)).otherwise((micros(last) - micros(first)).cast("long")).alias(name))
            else:
                out.append(_difference(x, order, kind, inside).alias(name))
        elif item.function == "LAST_BATCH":
            out.append(F.max_by(x, F.when(inside & F.col("__in_last"), order)).alias(name))
        else:
            value = AGGREGATES[item.function](F.when(inside, x), F.when(inside, order))
            out.append((F.floor(value + 0.5).cast("long") if item.function == "AVG" and source.is_duration(item.path) else value).alias(name))
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *out, *([F.count_if(is_of(aliases[0]) & F.col("__in_last")).alias("__last")] if last_batch else []))
    found = found.where("__last > 0" if last_batch else "__n > 0")
    ranks = rows.withColumns({c: F.when(F.col("__alias").isin(*mine), source.column(p)).cast("double") for (p, mine), c in values.items()})
    found = _with_percentiles(found, ranks, keys, ranked, whole)
    return found.select(*[F.col(f"__v{n}").alias(i.name) for n, i in enumerate(view.select)])


def _ordered(view: View, out: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in out.schema}
    down = lambda name: isinstance(kinds[name], T.NumericType)
    by = []
    for ref, direction in view.order_by:
        name = ref if ref in kinds else next((i.name for i in view.select if i.path == ref), None)
        if name is None:
            continue  # what cannot be found sorts nothing
        desc = direction.upper() == "DESC" if direction else down(name)
        by.append(F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_first())
    if not view.order_by and (view.group_by or any(i.function for i in view.select)):
        last = view.select[-1].name
        if isinstance(kinds[last], (T.NumericType, T.StringType)):
            by.append(F.col(last).desc_nulls_last() if down(last) else F.col(last).asc_nulls_first())
    if by:  # ties: by all other columns that can be ordered
        used = {i for i, _ in view.order_by}
        by += [F.col(n).asc_nulls_first() for n, k in kinds.items() if n not in used and not isinstance(k, (T.MapType, T.VariantType))]
    return out.orderBy(*by) if by else out


def _limited(out: DataFrame, n: int | None) -> DataFrame:
    return out if n is None else out.limit(n)
