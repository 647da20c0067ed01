"""Reductions of precision and size: ticks, clamps, aligned sizes, half floats, stack depth, dropped columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.formatting import FOREVER, NOT_AVAILABLE
from eventloom.functions.naming import class_name
from eventloom.functions.parsing import MOST_NS


def quantised(ns: Column, tick_ns: int) -> Column:
    """A time at the start of its tick (towards zero); the unset time stays."""
    return F.when(ns == NOT_AVAILABLE, ns).otherwise((ns - F.try_mod(ns, F.lit(tick_ns))).cast("long"))


def ticks(ns: Column, tick_ns: int) -> Column:
    return F.call_function("div", ns.cast("long"), F.lit(tick_ns).cast("long"))


def quantised_duration(ns: Column, tick_ns: int) -> Column:
    """A duration in whole ticks, at most a year either way; sentinels stay."""
    held = F.greatest(F.lit(-MOST_NS), F.least(F.lit(MOST_NS), ns))
    return F.when(ns.isin(NOT_AVAILABLE, FOREVER), ns).otherwise((held - F.try_mod(held, F.lit(tick_ns))).cast("long"))


def is_negligible(ns: Column, tick_ns: int) -> Column:
    return F.abs(ns) < tick_ns


#: The range of numbers that stand for sizes which are no multiple of 8.
ODD_SIZES = 1 << 60


def aligned(size: Column) -> Column:
    """Multiples of 8 as their eighth, other sizes (0 or more, below 2^60) in a range of their own; undone by unaligned()."""
    return F.when((size >= 0) & (size % 8 == 0), F.shiftright(size, 3)).otherwise(size + F.lit(ODD_SIZES))


def unaligned(code: Column) -> Column:
    return F.when(code >= ODD_SIZES - (1 << 59), code - F.lit(ODD_SIZES)).otherwise(F.shiftleft(code, 3))


def _bfloat16(x: pd.Series) -> pd.Series:
    raw = x.astype("float32").to_numpy(copy=True).view(np.uint32)
    held = ~np.isnan(x.to_numpy(dtype="float32"))
    raw[held] = (raw[held] + 0x7FFF + ((raw[held] >> 16) & 1)) & 0xFFFF0000
    return pd.Series(raw.view(np.float32))


def _float16(x: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        return pd.Series(x.to_numpy(dtype="float64").astype(np.float16).astype(np.float32))


def bfloat16(x: Column) -> Column:
    """The nearest number with 8 bits of mantissa (ties to even)."""
    return F.pandas_udf(_bfloat16, "float")(x)


def float16(x: Column) -> Column:
    """The nearest half-precision number; beyond its range infinite."""
    return F.pandas_udf(_float16, "float")(x)


def shallow(trace: Column, depth: int) -> Column:
    """A stack trace of at most so many frames, marked as truncated if it had more."""
    deep = F.size(trace["frames"]) > depth
    return F.when(trace.isNull(), trace).otherwise(trace.withField("truncated", trace["truncated"] | deep).withField("frames", F.slice(trace["frames"], 1, depth)))


def collapsed(frames: Column, is_internal) -> Column:
    """Frames with runs of three or more internal ones reduced to the first and last of the run."""
    n = F.size(frames)
    at = F.sequence(F.lit(1), n)

    def inner(k: Column) -> Column:
        around = (k > 1) & (k < n)
        return around & is_internal(F.try_element_at(frames, k)) & is_internal(F.try_element_at(frames, k - 1)) & is_internal(F.try_element_at(frames, k + 1))

    return F.when(n == 0, frames).otherwise(F.transform(F.filter(at, lambda k: ~F.coalesce(inner(k), F.lit(False))), lambda k: F.try_element_at(frames, k)))


@dataclass(frozen=True)
class Preset:
    """What is reduced, and how far, when events are stored."""

    time_tick_ns: int = 1
    duration_tick_ns: int = 1
    #: Data amounts and percentages, which fields' metadata name, in 8 bits of mantissa; doubles in 64, 32 or 16 bits.
    short_amounts: bool = False
    double_bits: int = 64
    stack_depth: int | None = None
    #: Which fields of DROPS go.
    drop: tuple[str, ...] = ("implied",)
    #: Class prefixes whose runs of frames are collapsed; none: no frames are.
    collapse: tuple[str, ...] = ()
    ignore_unnecessary: bool = True
    ignore_zero_ages: bool = False
    ignore_short_pauses: bool = False


PRESETS = {
    "lossless": Preset(),
    "default": Preset(1_000_000, 1_000, short_amounts=True, double_bits=32, stack_depth=32, drop=("implied", "lines", "addresses"), ignore_zero_ages=True),
    "reduced": Preset(1_000_000, 1_000, short_amounts=True, double_bits=16, stack_depth=16, drop=("implied", "lines", "addresses", "kinds"), ignore_zero_ages=True),
    "gc-log": Preset(1_000, 1_000, short_amounts=True, double_bits=32, drop=("implied", "addresses"), ignore_zero_ages=True),
}
#: Content types and column types that are kept in 8 bits of mantissa.
SHORT = {*(("DataAmount", k) for k in ("int", "bigint", "float", "double")), ("Percentage", "float")}
#: Fields that go, by event type and by the fields that tell a nested struct, and under which heading.
DROPS: dict[str, tuple[str, tuple[str, ...]]] = {
    "G1HeapRegionTypeChange": ("addresses", ("start",)),
    "G1HeapRegionInformation": ("addresses", ("start",)),
    "ThreadPark": ("addresses", ("address",)),
    "JavaMonitorWait": ("addresses", ("address",)),
    "JavaMonitorNotify": ("addresses", ("address",)),
    "JavaMonitorInflate": ("addresses", ("address",)),
    "JavaMonitorDeflate": ("addresses", ("address",)),
    "ShenandoahHeapRegionStateChange": ("addresses", ("start",)),
    "ShenandoahHeapRegionInformation": ("addresses", ("start",)),
    "ClassLoaderStatistics": ("addresses", ("classLoaderData",)),
    "CodeCacheFull": ("addresses", ("startAddress", "commitedTopAddress", "reservedTopAddress")),
    "CodeCacheStatistics": ("addresses", ("startAddress", "reservedTopAddress")),
    "CodeCacheConfiguration": ("addresses", ("startAddress", "reservedTopAddress")),
    "ParallelOldGarbageCollection": ("addresses", ("densePrefix",)),
    "ExecutionSample": ("implied", ("state",)),
    "NativeMethodSample": ("implied", ("state",)),
}
NESTED: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = (
    (("method", "lineNumber"), "lines", ("bytecodeIndex", "lineNumber")),
    (("method", "bytecodeIndex"), "lines", ("bytecodeIndex", "lineNumber")),
    (("method", "type"), "kinds", ("type",)),  # of a frame
    (("type", "name", "descriptor"), "kinds", ("modifiers", "hidden")),  # of a method
    (("name", "package"), "kinds", ("modifiers", "hidden")),  # of a class
    (("name", "classLoader"), "kinds", ("modifiers", "hidden")),
    (("start", "committedEnd", "reservedEnd"), "addresses", ("start", "committedEnd", "reservedEnd")),  # of a virtual space
    (("start", "end", "used", "size"), "addresses", ("start", "end")),  # of an object space
    (("address", "type", "referrer"), "addresses", ("address",)),  # of an old object
)


def _gone(kind: T.StructType, drop: tuple[str, ...]) -> set[str]:
    return {f for marks, heading, fields in NESTED if heading in drop and set(marks) <= set(kind.names) for f in fields if f in kind.names}


def _touches(kind: T.DataType, drop: tuple[str, ...]) -> bool:
    if isinstance(kind, T.ArrayType):
        return _touches(kind.elementType, drop)
    return isinstance(kind, T.StructType) and (bool(_gone(kind, drop)) or any(_touches(f.dataType, drop) for f in kind))


def without_fields(x: Column, kind: T.DataType, drop: tuple[str, ...]) -> Column:
    """A nested column without the fields of NESTED that go under the headings, at any depth; null stays null."""
    if isinstance(kind, T.ArrayType) and _touches(kind, drop):
        return F.transform(x, lambda e: without_fields(e, kind.elementType, drop))
    if not isinstance(kind, T.StructType):
        return x
    gone = _gone(kind, drop)
    for f in kind:
        if f.name not in gone and _touches(f.dataType, drop):
            x = x.withField(f.name, without_fields(x[f.name], f.dataType, drop))
    return x.dropFields(*sorted(gone)) if gone else x


def reduced(events: DataFrame, preset: Preset, event_type: str = "") -> DataFrame:
    """events by a preset: *_ns columns in ticks, data amounts and doubles in fewer bits, shallow stack traces, dropped fields.

    Data amounts and percentages are the columns whose metadata say so (contentType); they keep their type. Fields go by DROPS and NESTED.
    """
    out: dict[str, Column] = {}
    heading, fields = DROPS.get(event_type.rpartition(".")[2], ("", ()))
    gone = [f for f in fields if heading in preset.drop]
    for f in events.schema:
        x = F.col(f.name)
        kind = f.dataType.simpleString()
        if f.name in ("start_ns", "end_ns"):
            new = quantised(x, preset.time_tick_ns) if preset.time_tick_ns > 1 else x
        elif f.name.endswith("_ns"):
            new = quantised_duration(x, preset.duration_tick_ns) if preset.duration_tick_ns > 1 else x
        elif preset.short_amounts and (f.metadata.get("contentType"), kind) in SHORT:
            new = bfloat16(x.cast("float")).cast(f.dataType)
        elif kind == "double" and preset.double_bits < 64:
            new = (float16(x) if preset.double_bits == 16 else x.cast("float")).cast("double")
        else:
            new = x
            is_trace = f.name == "stackTrace" and isinstance(f.dataType, T.StructType) and "frames" in f.dataType.names
            if is_trace and preset.stack_depth:
                new = shallow(new, preset.stack_depth)
            if is_trace and preset.collapse:
                inner = lambda e: class_name(e["method"]["type"]["name"]).rlike("^(" + "|".join(re.escape(p) for p in preset.collapse) + ")")
                new = F.when(new.isNull(), new).otherwise(new.withField("frames", collapsed(new["frames"], inner)))
            if _touches(f.dataType, preset.drop):
                new = without_fields(new, f.dataType, preset.drop)
        if new is not x:
            out[f.name] = new
    for name, new in out.items():
        events = events.withColumn(name, new.alias(name, metadata=events.schema[name].metadata))
    return events.drop(*gone)
