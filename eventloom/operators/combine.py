"""Events grouped into nested records, and expanded back: exactly, or as far as the combination keeps them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.ranges import same, with_previous, with_running_sum

#: Events that a list holds at most, or so; further ones of the same group and key are in rows of their own.
CHUNK = 50_000


@dataclass(frozen=True)
class Combination:
    """How a type's events are combined: group, then key fields, then what is kept of the events of one key.

    leaf: sum (of value), count, list (of value), structs (of fields), stats (count, sum, min, max of value) or last (of fields).
    drop_zero: sums of 0 are left out. defaults: columns that expansion fills in.
    """

    event_type: str
    group: str = "gcId"
    keys: tuple[str, ...] = ()
    leaf: str = "structs"
    value: str | None = None
    fields: tuple[str, ...] = ()
    drop_zero: bool = False
    exact: bool = False
    defaults: dict[str, object] = field(default_factory=dict, hash=False)

    def bound(self, columns: list[str], lossless: bool = False, drop_zero: bool = True) -> Combination | None:
        """This combination for a table of such columns; None if these lack what it needs.

        Exact lists hold all other columns of the table. lossless: so does any other leaf, so that nothing is lost.
        """
        have = {*columns, "nextGCId"} | ({"packedAge"} if {"tenured", "tenuringAge"} <= set(columns) else set()) | ({"residual"} if {"id", "value", "increment"} <= set(columns) else set())
        keys = tuple(k for k in self.keys if k in columns) if lossless else self.keys
        if self.group not in have or not set(keys) <= have or self.value and not lossless and self.value not in have:
            return None
        if lossless or self.exact and self.leaf == "structs":
            coded = "residual" in self.fields and "residual" in have
            fields = tuple(c for c in columns if c not in (self.group, *keys) and not (coded and c == "value"))
            return replace(self, keys=keys, leaf="structs", value=None, fields=fields + (("residual",) if coded else ()), exact=True, drop_zero=False)
        fields = tuple(f for f in self.fields if f in have)
        if self.leaf in ("structs", "last") and not fields:
            return None
        return replace(self, fields=fields, drop_zero=self.drop_zero and drop_zero)


def combined(events: DataFrame, spec: Combination, start: str = "start_ns", order: tuple[str, ...] = ("start_ns", "seq")) -> DataFrame:
    """A row for each group and key: group, start (of the group's first event), the keys and leaf. Null groups and keys are some.

    Sums, counts, statistics and last ones are aggregated before the shuffle. Lists hold their events by `order`; a key of more than CHUNK
    events has several rows, dealt by a hash of the order, so that no row and no task holds a hot group.
    """
    seq = F.struct(*order)
    value = F.col(spec.value) if spec.value else None
    own, listed = [spec.group, *spec.keys], spec.leaf in ("list", "structs")
    leaf: Column
    if spec.leaf == "sum":
        leaf = F.sum(value)
    elif spec.leaf == "count":
        leaf = F.count(F.lit(1))
    elif spec.leaf == "list":
        leaf = F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("o"), value.alias("v")))), lambda x: x["v"])
    elif spec.leaf == "structs":
        leaf = F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("o"), F.struct(*spec.fields).alias("v")))), lambda x: x["v"])
    elif spec.leaf == "stats":
        leaf = F.struct(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    elif spec.leaf == "last":
        leaf = F.max_by(F.struct(*spec.fields), seq)
    else:
        raise ValueError(f"no such leaf: {spec.leaf}")
    chunk = []
    rows = events
    if listed:
        large = events.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CHUNK)
        large = large.select(*[F.col(k).alias(f"{k}__l") for k in own], F.ceil(F.col("__n") / CHUNK).alias("__parts"))
        rows = events.join(large, same(events, large, own, "__l"), "left").withColumn("__chunk", F.coalesce(F.pmod(F.xxhash64(*order), "__parts"), F.lit(0)))
        chunk = ["__chunk"]
    each = rows.groupBy(*own, *chunk).agg(leaf.alias("leaf")).drop("__chunk")
    if spec.drop_zero:
        each = each.where("leaf <> 0")
    kept = events
    if spec.drop_zero:  # groups of which nothing is left have no start; others start with what is left
        kept = events.groupBy(*own).agg(F.min(start).alias(start), F.sum(value).alias("__sum")).where("__sum <> 0")
    starts = kept.groupBy(F.col(spec.group).alias(f"{spec.group}__s")).agg(F.min(start).alias(start))
    return each.join(starts, each[spec.group].eqNullSafe(starts[f"{spec.group}__s"])).select(spec.group, start, *spec.keys, "leaf")


def entry_counts(rows: DataFrame, spec: Combination, start: str = "start_ns") -> DataFrame:
    """Of combined rows, how many keys each group has: group, start and entries."""
    distinct = F.count_distinct(F.struct(*spec.keys)) if spec.keys else F.max(F.lit(1))
    return rows.groupBy(spec.group).agg(F.min(start).alias(start), distinct.cast("int").alias("entries"))


def expanded(rows: DataFrame, spec: Combination, start: str = "start_ns") -> DataFrame:
    """The events again: each list's elements, a count's rows, a sum as one row; fields that were not kept take the defaults.

    For lists of structs the result equals the input's columns but order; sums come back as one event for each key.
    """
    base = [F.col(spec.group), F.col(start).alias("__start"), *[F.col(k) for k in spec.keys]]
    if spec.leaf == "list":
        out = rows.select(*base, F.explode("leaf").alias(spec.value))
    elif spec.leaf == "structs":
        out = rows.select(*base, F.explode("leaf").alias("__v")).select(spec.group, "__start", *spec.keys, "__v.*")
    elif spec.leaf == "count":
        out = rows.select(*base, F.explode(F.sequence(F.lit(1).cast("long"), F.col("leaf"))).alias("__k")).drop("__k")
    elif spec.leaf in ("last", "stats"):
        out = rows.select(*base, "leaf.*")
    else:
        out = rows.select(*base, F.col("leaf").alias(spec.value))
    for name, v in spec.defaults.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(v))
    return out.drop("__start") if start in out.columns else out.withColumnRenamed("__start", start)


def residuals(events: DataFrame, key: str, value: str, increment: str, order: tuple[str, ...], to: str = "residual") -> DataFrame:
    """What each running value differs from the one before (0 at first) plus its increment; mostly 0."""
    marked = with_previous(events, [key], F.col(value), list(order))
    return marked.withColumn(to, F.col(value) - F.coalesce("__last", F.lit(0)) - F.col(increment)).drop("__last", "__first")


def from_residuals(events: DataFrame, key: str, increment: str, order: tuple[str, ...], residual: str = "residual", to: str = "value") -> DataFrame:
    """The running values again: the sums of residuals and increments so far."""
    return with_running_sum(events, [key], F.col(residual) + F.col(increment), list(order), to)


def before_and_after(events: DataFrame, group: str = "gcId", when: str = "when", payload: str = "heapSpace", names: tuple[str, str] = ("Before GC", "After GC")) -> DataFrame:
    """One row a group with the payloads before and after."""
    return events.groupBy(group).agg(*[F.max_by(F.when(F.col(when) == n, F.col(payload)), F.when(F.col(when) == n, F.col("seq"))).alias(a) for n, a in zip(names, ("before", "after"), strict=True)])


def packed_age(tenured: Column, age: Column) -> Column:
    """Tenured flag and age in one number."""
    return tenured.cast("int") * 64 + age


def unpacked_age(packed: Column) -> tuple[Column, Column]:
    """The tenured flag and the age of such a number."""
    return packed >= 64, packed % 64


def floor_power_of_two(size: Column) -> Column:
    return F.when(size > 0, F.pow(F.lit(2.0), F.floor(F.log2(size))).cast("long")).otherwise(F.lit(0).cast("long"))


_TIMED = ("start_ns", "seq", "duration_ns", "eventThread")
_WAIT = {"duration_ns": 0, "stackTrace": None, "eventThread": None}
#: The combinations by name. nextGCId groups events by the next collection after them (see asof.next_id).
COMBINATIONS = {
    "ObjectAllocationInNewTLAB": Combination("ObjectAllocationInNewTLAB", "nextGCId", ("objectClass", "tlabSize"), "list", "allocationSize", defaults=_WAIT),
    "ObjectAllocationInNewTLAB.sum": Combination("ObjectAllocationInNewTLAB", "nextGCId", ("objectClass",), "sum", "allocationSize", defaults=_WAIT),
    "ObjectAllocationOutsideTLAB": Combination("ObjectAllocationOutsideTLAB", "nextGCId", ("objectClass",), "list", "allocationSize", defaults=_WAIT),
    "ObjectAllocationOutsideTLAB.sum": Combination("ObjectAllocationOutsideTLAB", "nextGCId", ("objectClass",), "sum", "allocationSize", defaults=_WAIT),
    "PromoteObjectInNewPLAB": Combination("PromoteObjectInNewPLAB", "gcId", ("objectClass", "packedAge", "plabSize", "eventThread"), "list", "objectSize"),
    "PromoteObjectInNewPLAB.sum": Combination("PromoteObjectInNewPLAB", "gcId", ("objectClass", "packedAge", "plabSize"), "sum", "objectSize"),
    "PromoteObjectOutsidePLAB": Combination("PromoteObjectOutsidePLAB", "gcId", ("objectClass", "packedAge", "eventThread"), "list", "objectSize"),
    "PromoteObjectOutsidePLAB.sum": Combination("PromoteObjectOutsidePLAB", "gcId", ("objectClass", "packedAge"), "sum", "objectSize"),
    "TenuringDistribution": Combination("TenuringDistribution", "gcId", ("age",), "sum", "size", drop_zero=True),
    **{t: Combination(t, "gcId", ("name",), "structs", None, _TIMED, exact=True) for t in ("GCPhasePause", "GCPhasePauseLevel1", "GCPhasePauseLevel2", "GCPhasePauseLevel3", "GCPhasePauseLevel4", "GCPhaseConcurrent", "GCPhaseConcurrentLevel1")},
    "GCPhaseParallel": Combination("GCPhaseParallel", "gcId", ("name",), "structs", None, (*_TIMED, "gcWorkerId"), exact=True),
    "GCPhaseParallel.stats": Combination("GCPhaseParallel", "gcId", ("name",), "stats", "duration_ns"),
    "ObjectAllocationSample": Combination("ObjectAllocationSample", "nextGCId", ("objectClass",), "list", "weight", defaults=_WAIT),
    "ObjectAllocationSample.sum": Combination("ObjectAllocationSample", "nextGCId", ("objectClass",), "sum", "weight", defaults=_WAIT),
    "ObjectAllocationSample.exact": Combination("ObjectAllocationSample", "nextGCId", ("objectClass", "stackTrace", "eventThread"), "list", "weight"),
    "GCReferenceStatistics": Combination("GCReferenceStatistics", "gcId", ("type",), "last", None, ("start_ns", "count"), exact=True),
    "ZStatisticsCounter": Combination("ZStatisticsCounter", "nextGCId", ("id",), "structs", None, ("start_ns", "seq", "increment", "residual"), exact=True),
    "ZStatisticsSampler": Combination("ZStatisticsSampler", "nextGCId", ("id",), "structs", None, ("start_ns", "seq", "value"), exact=True),
    "ObjectCount": Combination("ObjectCount", "gcId", ("objectClass",), "last", None, ("count", "totalSize")),
    "ObjectCountAfterGC": Combination("ObjectCountAfterGC", "gcId", ("objectClass",), "last", None, ("count", "totalSize")),
    "MetaspaceChunkFreeListSummary": Combination("MetaspaceChunkFreeListSummary", "gcId", ("when", "metadataType"), "last", None, ("specializedChunks", "smallChunks", "mediumChunks", "humongousChunks")),
    "GCHeapSummary": Combination("GCHeapSummary", "gcId", ("when",), "last", None, ("heapSpace", "heapUsed")),
    "G1HeapSummary": Combination("G1HeapSummary", "gcId", ("when",), "last", None, ("edenUsedSize", "survivorUsedSize", "numberOfRegions")),
    "MetaspaceSummary": Combination("MetaspaceSummary", "gcId", ("when",), "last", None, ("metaspace",)),
    "PSHeapSummary": Combination("PSHeapSummary", "gcId", ("when",), "last", None, ("oldSpace", "youngSpace")),
    "G1HeapRegionTypeChange": Combination("G1HeapRegionTypeChange", "nextGCId", ("from", "to"), "structs", None, ("index", "start", "used")),
    "G1HeapRegionInformation": Combination("G1HeapRegionInformation", "nextGCId", ("index",), "structs", None, ("start_ns", "seq", "type", "start", "used"), exact=True),
    "JavaExceptionThrow": Combination("JavaExceptionThrow", "nextGCId", ("thrownClass",), "count", defaults={"message": None}),
    "JavaExceptionThrow.exact": Combination("JavaExceptionThrow", "nextGCId", ("thrownClass", "stackTrace"), "structs", None, ("start_ns", "seq", "eventThread", "message"), exact=True),
    "JavaErrorThrow": Combination("JavaErrorThrow", "nextGCId", ("thrownClass",), "count", defaults={"message": None}),
    "ThreadPark.exact": Combination("ThreadPark", "nextGCId", ("parkedClass",), "structs", None, ("start_ns", "seq", "duration_ns", "eventThread", "stackTrace", "timeout", "until", "address"), exact=True),
    "ThreadPark.count": Combination("ThreadPark", "nextGCId", ("parkedClass",), "count", defaults={**_WAIT, "timeout": 0, "until": 0, "address": 0}),
    "ThreadPark": Combination("ThreadPark", "nextGCId", ("parkedClass",), "list", "duration_ns", defaults={"timeout": 0, "until": 0, "address": 0}),
    "ThreadSleep.count": Combination("ThreadSleep", "nextGCId", ("time",), "count", defaults=_WAIT),
    "ThreadSleep": Combination("ThreadSleep", "nextGCId", ("time",), "list", "duration_ns"),
    "JavaMonitorEnter.count": Combination("JavaMonitorEnter", "nextGCId", ("monitorClass",), "count", defaults=_WAIT),
    "JavaMonitorEnter": Combination("JavaMonitorEnter", "nextGCId", ("address",), "structs", None, ("monitorClass", "eventThread", "duration_ns", "stackTrace", "previousOwner")),
    "JavaMonitorWait.count": Combination("JavaMonitorWait", "nextGCId", ("monitorClass",), "count", defaults=_WAIT),
    "JavaMonitorWait": Combination("JavaMonitorWait", "nextGCId", ("monitorClass",), "list", "duration_ns"),
    "ExecutionSample": Combination("ExecutionSample", "nextGCId", ("stackTrace",), "structs", None, ("start_ns", "seq", "sampledThread"), exact=True),
    "NativeMethodSample": Combination("NativeMethodSample", "nextGCId", ("stackTrace",), "structs", None, ("start_ns", "seq", "sampledThread"), exact=True),
}

#: The types that each preset combines, and by which combination.
_PHASES = ("GCPhasePause", "GCPhasePauseLevel1", "GCPhasePauseLevel2", "GCPhasePauseLevel3", "GCPhasePauseLevel4", "GCPhaseConcurrent", "GCPhaseConcurrentLevel1")
_COUNTS = ("GCReferenceStatistics", "ZStatisticsCounter", "ZStatisticsSampler", "ObjectCount", "ObjectCountAfterGC", "MetaspaceChunkFreeListSummary", "TenuringDistribution")
_PAIRS = ("GCHeapSummary", "G1HeapSummary", "MetaspaceSummary", "PSHeapSummary")
_REGIONS = ("G1HeapRegionTypeChange", "G1HeapRegionInformation")
_PROMOTIONS = ("PromoteObjectInNewPLAB", "PromoteObjectOutsidePLAB")
_BASIC = {t: t for t in (*_PHASES, "GCPhaseParallel", *_COUNTS, *_PAIRS, *_REGIONS, *_PROMOTIONS)} | {"ThreadPark": "ThreadPark.exact"}
BY_PRESET = {
    "lossless": _BASIC,
    "default": _BASIC | {"ObjectAllocationSample": "ObjectAllocationSample.exact"},
    "reduced": _BASIC
    | {t: f"{t}.sum" for t in (*_PROMOTIONS, "ObjectAllocationSample", "ObjectAllocationInNewTLAB", "ObjectAllocationOutsideTLAB")}
    | {t: t for t in ("JavaExceptionThrow", "JavaErrorThrow", "ThreadPark", "ThreadSleep", "JavaMonitorEnter", "JavaMonitorWait")},
    "gc-log": _BASIC | {"GCPhaseParallel": "GCPhaseParallel.stats"},
}
