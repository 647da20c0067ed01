"""Views over the event tables: projections, aggregates, ordering, unions and correlated aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.formatting import FOREVER
from eventloom.functions.percentiles import nearest_rank
from eventloom.plans.catalogue import E, events, query, table
from eventloom.plans.views import Item, Source, View, agg, evaluate, field
from eventloom.sources.catalog import Catalog

TYPES = ("click", "error", "purchase", "signup", "view")


def catalog(spark, sf) -> Catalog:
    rows = events(spark, sf)
    types = Catalog.of_column(rows, list(TYPES)).tables
    return Catalog({"events": rows, **{f"app.{t}": df for t, df in types.items()}}, {f"app.{t}": t.title() for t in TYPES}, package="app.")


def exc(x: str, p: float) -> str:
    """SQL of an exclusive percentile with clamped ends; nulls are left out."""
    a, r = f"list_sort(list({x}) filter ({x} is not null))", f"greatest(0.0, least({p} / 100.0 * (count({x}) + 1) - 1, count({x}) - 1.0))"
    low = f"cast(floor({r}) as bigint)"
    high = f"least({low} + 1, count({x}) - 1)"
    return f"({a}[{low} + 1] + ({r} - floor({r})) * ({a}[{high} + 1] - {a}[{low} + 1]))"


@query(
    "view_event_stats",
    f"select event_type as T, count(*) as N, round(avg(value), 6) as mean, {exc('value', 95)} as p95 from events group by 1 order by N desc limit 5",
)
def view_event_stats(spark, sf):
    view = View((field("T", "event_type"), agg("N", "COUNT"), agg("mean", "AVG", "value"), agg("p95", "P95", "value")), (Source("events"),), group_by=("event_type",), order_by=(("N", "DESC"),), limit=5)
    return evaluate(view, catalog(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("proj_fields", "select event_id, user_id as u, value from events where event_type = 'purchase'")
def proj_fields(spark, sf):
    return evaluate(View((field("event_id"), field("u", "user_id"), field("value")), (Source("purchase"),)), catalog(spark, sf))


@query("proj_star", "select event_id, ts, user_id, event_type, value, props from events where event_type = 'signup'")
def proj_star(spark, sf):
    return evaluate(View((field("*", "*"),), (Source("signup"),)), catalog(spark, sf)).drop("us", "k")


@query("proj_nested_json", f"select event_id, k, cast(null as int) as missing from {E} where event_type = 'error'")
def proj_nested_json(spark, sf):
    return evaluate(View((field("event_id"), field("k"), field("missing", "props.no.such")), (Source("error"),)), catalog(spark, sf)).withColumn("missing", F.col("missing").cast("int"))


@query("filter_eq_and", "select event_id, value from events where event_type = 'view' and cast(user_id as varchar) = '7'")
def filter_eq_and(spark, sf):
    return evaluate(View((field("event_id"), field("value")), (Source("events"),), where=(("event_type", "view"), ("user_id", "7"))), catalog(spark, sf))


def grouped(spark, sf, *items: Item, by=("event_type",), source="events", order=(), limit=None, normalized=()):
    return evaluate(View(items, (Source(source),), group_by=by, order_by=order, limit=limit, normalized=normalized), catalog(spark, sf))


def simple(name: str, items: tuple[Item, ...], sql: str, **more):
    query(name, sql)(lambda spark, sf: grouped(spark, sf, field("event_type"), *items, **more))


simple("agg_count_star", (agg("n", "COUNT"),), "select event_type, count(*) as n from events group by 1")
simple("agg_count_nulls", (agg("n", "COUNT", "k"),), "select event_type, count(*) as n from events group by 1")
simple("agg_sum", (agg("total", "SUM", "k"),), f"select event_type, cast(sum(k) as bigint) as total from {E} group by 1")
simple("agg_avg", (agg("mean", "AVG", "k"),), f"select event_type, avg(k) as mean from {E} group by 1")
simple("agg_minmax", (agg("low", "MIN", "value"), agg("high", "MAX", "value")), "select event_type, min(value) as low, max(value) as high from events group by 1")
simple("agg_first", (agg("x", "FIRST", "value"),), "select event_type, arg_min_null(value, (ts, event_id)) as x from events group by 1")
simple("agg_last", (agg("x", "LAST", "value"),), "select event_type, arg_max_null(value, (ts, event_id)) as x from events group by 1")
simple(
    "agg_diff",
    (agg("x", "DIFF", "value"), agg("span_us", "DIFF", "ts")),
    "select event_type, cast(trunc(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) as bigint) as x, epoch_us(arg_max(ts, (ts, event_id))) - epoch_us(arg_min(ts, (ts, event_id))) as span_us from events group by 1",
)
simple("agg_unique", (agg("users", "UNIQUE", "user_id"),), "select event_type, count(distinct user_id) as users from events group by 1")


@query("agg_set", f"select event_type, array_to_string(list_sort(list(distinct k)), ',') as ks from {E} where user_id < 20 group by 1")
def agg_set(spark, sf):
    cat = catalog(spark, sf)
    cat.tables["events"] = cat.tables["events"].where("user_id < 20")
    out = evaluate(View((field("event_type"), agg("ks", "SET", "k")), (Source("events"),), group_by=("event_type",)), cat)
    return out.withColumn("ks", F.array_join(F.transform("ks", lambda x: x.cast("string")), ","))


@query("agg_set_all", f"select event_type, array_to_string(list_sort(list(distinct k)), ',') as ks from {E} group by 1")
def agg_set_all(spark, sf):
    """agg_set over the events of all users."""
    out = grouped(spark, sf, field("event_type"), agg("ks", "SET", "k"))
    return out.withColumn("ks", F.array_join(F.transform("ks", lambda x: x.cast("string")), ","))


for _name, _p in (("MEDIAN", 50), ("P90", 90), ("P95", 95), ("P99", 99), ("P999", 99.9)):
    simple(f"agg_{_name.lower()}", (agg("x", _name, "value"),), f"select event_type, {exc('value', _p)} as x from events group by 1")

simple(
    "agg_percentiles_together",
    (agg("n", "COUNT"), agg("a", "MEDIAN", "value"), agg("b", "P99", "value"), agg("c", "P90", "k")),
    f"select event_type, count(*) as n, {exc('value', 50)} as a, {exc('value', 99)} as b, {exc('k', 90)} as c from {E} group by 1",
)


@query("nearest_rank_p95", "select event_type, list_sort(list(value))[cast(floor(count(*) / 2) as int) + 1] as median, list_sort(list(value))[cast(least(count(*) - 1, floor(count(*) * 95 / 100)) as int) + 1] as p95 from events group by 1")
def nearest_rank_p95(spark, sf):
    return nearest_rank(events(spark, sf), ["event_type"], "value", {"median": 50, "p95": 95})


@query(
    "last_batch",
    "with d as (select o_orderpriority, o_custkey, o_orderkey, o_totalprice, o_orderdate from orders), m as (select max(o_orderdate) as latest from d) select o_orderpriority as p, arg_max_null(o_totalprice, o_orderkey) as price, arg_min_null(o_custkey, o_orderkey) as c from d, m where o_orderdate = latest group by 1",
)
def last_batch(spark, sf):
    rows = table(spark, sf, "orders").withColumnsRenamed({"o_orderdate": "ts", "o_orderkey": "event_id"})
    view = View((field("p", "o_orderpriority"), agg("price", "LAST_BATCH", "o_totalprice"), field("c", "o_custkey")), (Source("orders"),), group_by=("o_orderpriority",))
    return evaluate(view, Catalog({"orders": rows}))


@query("group_multi_key", f"select event_type, k, count(*) as n, max(value) as top from {E} group by 1, 2")
def group_multi_key(spark, sf):
    return grouped(spark, sf, field("event_type"), field("k"), agg("n", "COUNT"), agg("top", "MAX", "value"), by=("event_type", "k"))


@query("group_by_alias", "select user_id as who, count(*) as n from events group by 1")
def group_by_alias(spark, sf):
    return grouped(spark, sf, field("who", "user_id"), agg("n", "COUNT"), by=("who",))


@query("group_rep_row", "select user_id, arg_min_null(event_type, (ts, event_id)) as event_type, arg_min_null(value, (ts, event_id)) as value, count(*) as n from events group by 1")
def group_rep_row(spark, sf):
    return grouped(spark, sf, field("user_id"), field("event_type"), field("value"), agg("n", "COUNT"), by=("user_id",))


@query("global_agg", f"select count(*) as n, max(value) as high, {exc('value', 90)} as p90 from events having count(*) > 0")
def global_agg(spark, sf):
    return evaluate(View((agg("n", "COUNT"), agg("high", "MAX", "value"), agg("p90", "P90", "value")), (Source("events"),)), catalog(spark, sf))


@query("global_agg_empty", "select count(*) as n, max(value) as high from events where event_type = 'no such type' having count(*) > 0")
def global_agg_empty(spark, sf):
    return evaluate(View((agg("n", "COUNT"), agg("high", "MAX", "value")), (Source("events"),), where=(("event_type", "no such type"),)), catalog(spark, sf))


@query("share_of_total_prelimit", "select user_id, count(*) as n, count(*) / sum(count(*)) over () as share from events group by 1 order by n desc, user_id limit 10")
def share_of_total_prelimit(spark, sf):
    return grouped(spark, sf, field("user_id"), agg("n", "COUNT"), by=("user_id",), order=(("n", "DESC"), ("user_id", "ASC")), limit=10, normalized=(("n", "share"),))


@query("order_default_last_col", "select user_id, max(value) as top from events group by 1 order by top desc nulls last, user_id limit 20")
def order_default_last_col(spark, sf):
    """The first rows by that order: its LIMIT is what is shown. The order itself is that of all rows."""
    return grouped(spark, sf, field("user_id"), agg("top", "MAX", "value"), by=("user_id",), limit=20)


@query("order_default_text", "select user_id, arg_min_null(event_type, (ts, event_id)) as first_type from events group by 1 order by first_type asc nulls first, user_id limit 25")
def order_default_text(spark, sf):
    """The first rows by that order: its LIMIT is what is shown. The order itself is that of all rows."""
    return grouped(spark, sf, field("user_id"), field("first_type", "event_type"), by=("user_id",), limit=25)


@query("order_agg_arg", "select user_id, cast(sum(cast(json_extract(props, '$.k') as int)) as bigint) as total from events group by 1 order by total desc, user_id limit 15")
def order_agg_arg(spark, sf):
    """The first rows by that order: its LIMIT is what is shown. The order itself is that of all rows."""
    return grouped(spark, sf, field("user_id"), agg("total", "SUM", "k"), by=("user_id",), order=(("k", None),), limit=15)


@query("topk_limit", "select event_id, value from events order by value desc nulls last, event_id limit 12")
def topk_limit(spark, sf):
    return evaluate(View((field("event_id"), field("value")), (Source("events"),), order_by=(("value", "DESC"),), limit=12), catalog(spark, sf))


@query("union_types", "select event_type, count(*) as n, round(avg(value), 6) as mean from events where event_type in ('click', 'view') group by 1")
def union_types(spark, sf):
    return evaluate(View((field("event_type"), agg("n", "COUNT"), agg("mean", "AVG", "value")), (Source("click"), Source("view")), group_by=("event_type",)), catalog(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("union_fields_of_one_type", "select count(*) as rows, count(*) filter (event_type = 'click') as clicks, sum(k) filter (event_type = 'click') as k from " + E + " where event_type in ('click', 'error')")
def union_fields_of_one_type(spark, sf):
    cat = catalog(spark, sf)
    cat.tables["app.error"] = cat.tables["app.error"].drop("k")
    return evaluate(View((agg("rows", "COUNT"), agg("clicks", "COUNT", "k"), agg("k", "SUM", "k")), (Source("click"), Source("error"))), cat)


@query("from_star_counts", "select 'app.' || event_type as event_type, upper(event_type[1]) || event_type[2:] as event_label, count(*) as n from events group by 1, 2")
def from_star_counts(spark, sf):
    cat = catalog(spark, sf)
    del cat.tables["events"]
    return cat.everything().groupBy("event_type", "event_label").agg(F.count(F.lit(1)).alias("n"))


def joined(spark, sf, *items: Item, aliases: tuple[tuple[str, str], ...], where=()):
    return evaluate(View(items, tuple(Source(t, a) for t, a in aliases), where=where, group_by=("user_id",)), catalog(spark, sf))


def one_alias(a: str, t: str, more: str = "") -> str:
    return f"{a} as (select user_id, count(*) as n, arg_min_null(value, (ts, event_id)) as value, arg_min_null(event_id, (ts, event_id)) as event_id, epoch_us(arg_min_null(ts, (ts, event_id))) as first_us, epoch_us(arg_max_null(ts, (ts, event_id))) as last_us from events where event_type = '{t}' {more} group by 1)"


BE = (("signup", "B"), ("error", "E"))


@query(
    "selfjoin_two_alias",
    f"with {one_alias('b', 'signup')}, {one_alias('e', 'error')} select coalesce(b.user_id, e.user_id) as user_id, b.value as b_value, e.value as e_value, coalesce(b.n, 0) as b_n, coalesce(e.n, 0) as e_n from b full join e on b.user_id is not distinct from e.user_id",
)
def selfjoin_two_alias(spark, sf):
    return joined(spark, sf, field("user_id"), field("b_value", "value", "B"), field("e_value", "value", "E"), agg("b_n", "COUNT", "*", "B"), agg("e_n", "COUNT", "*", "E"), aliases=BE)


@query(
    "selfjoin_coalesce",
    f"with {one_alias('b', 'signup')}, {one_alias('e', 'error')} select coalesce(b.user_id, e.user_id) as user_id, case when b.n > 0 then b.event_id else e.event_id end as which from b full join e on b.user_id is not distinct from e.user_id",
)
def selfjoin_coalesce(spark, sf):
    return joined(spark, sf, field("user_id"), field("which", "event_id", "B", "E"), aliases=BE)


@query(
    "selfjoin_diff_indefinite",
    f"with {one_alias('b', 'signup')}, {one_alias('e', 'error')} select coalesce(b.user_id, e.user_id) as user_id, case when b.n > 0 and e.n > 0 then e.last_us - b.first_us else {FOREVER} end as span from b full join e on b.user_id is not distinct from e.user_id",
)
def selfjoin_diff_indefinite(spark, sf):
    return joined(spark, sf, field("user_id"), agg("span", "DIFF", "ts", "B", "E"), aliases=BE)


SIX = tuple((t, a) for t, a in zip((*TYPES, "click"), "ABCDEF", strict=True))


@query(
    "selfjoin_six_alias",
    "select user_id, " + ", ".join(f"count(*) filter (event_type = '{t}'{' and cast(user_id as varchar) = ' + chr(39) + '3' + chr(39) if a == 'F' else ''}) as n_{a.lower()}" for t, a in SIX) + " from events group by 1",
)
def selfjoin_six_alias(spark, sf):
    return joined(spark, sf, field("user_id"), *[agg(f"n_{a.lower()}", "COUNT", "*", a) for _, a in SIX], aliases=SIX, where=(("F.user_id", "3"),))


@query(
    "last_batch_join",
    "with x as (select *, date_trunc('day', ts) as day from events where event_type in ('view', 'error')), m as (select event_type, max(day) as latest from x group by 1), l as (select x.*, x.day = latest as in_last from x join m using (event_type)) select user_id, arg_max_null(event_id, (day, event_id)) filter (event_type = 'view' and in_last) as v, arg_max_null(event_id, (day, event_id)) filter (event_type = 'error' and in_last) as e from l group by 1 having count(*) filter (event_type = 'view' and in_last) > 0",
)
def last_batch_join(spark, sf):
    cat = catalog(spark, sf)
    cat.tables = {n: df.withColumn("ts", F.date_trunc("day", "ts")) for n, df in cat.tables.items()}
    view = View((field("user_id"), agg("v", "LAST_BATCH", "event_id", "V"), agg("e", "LAST_BATCH", "event_id", "E")), (Source("view", "V"), Source("error", "E")), group_by=("user_id",))
    return evaluate(view, cat)


@query("selfjoin_two_keys", f"select user_id, k, count(*) filter (event_type = 'signup') as b_n, count(*) filter (event_type = 'error') as e_n from {E} where event_type in ('signup', 'error') group by 1, 2")
def selfjoin_two_keys(spark, sf):
    items = (field("user_id"), field("k"), agg("b_n", "COUNT", "*", "B"), agg("e_n", "COUNT", "*", "E"))
    return evaluate(View(items, tuple(Source(t, a) for t, a in BE), group_by=("user_id", "B.k")), catalog(spark, sf))


_SIGNUP = "case when event_type = 'signup' then value end"


@query("selfjoin_percentiles", f"select user_id, {exc(_SIGNUP, 90)} as p90, {exc('value', 50)} as median, {exc('k', 95)} as p95 from {E} where event_type in ('signup', 'error') group by 1")
def selfjoin_percentiles(spark, sf):
    return joined(spark, sf, field("user_id"), agg("p90", "P90", "value", "B"), agg("median", "MEDIAN", "value", "B", "E"), agg("p95", "P95", "k"), aliases=BE)


@query("group_by_displayed", f"select 't' || (user_id % 5) as thread, count(*) as n from {E} group by 1")
def group_by_displayed(spark, sf):
    """Structs that differ in what is not shown are one group."""
    rows = events(spark, sf).withColumn("owner", F.expr("named_struct('name', concat('t', user_id % 5), 'hidden', user_id)"))
    out = evaluate(View((field("owner"), agg("n", "COUNT")), (Source("rows"),), group_by=("owner",)), Catalog({"rows": rows}))
    return out.select(F.col("owner.name").alias("thread"), "n")
