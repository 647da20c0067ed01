import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventloom.operators import asof, combine, dedup, filters, ranges, reduce
from eventloom.operators.combine import COMBINATIONS, Combination


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("per_range", [1000, 20])
def test_lookups(spark, seed, per_range, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", per_range)
    rng = random.Random(seed)
    times = [(k, rng.choice([None, rng.randint(0, 500)])) for k in range(150)]
    marks = [(rng.randint(100, 400), k) for k in range(12)] + [(None, 77)]
    e, m = spark.createDataFrame(times, "i int, t long"), spark.createDataFrame(marks, "at long, id int")
    real = [x for x in marks if x[0] is not None]
    for forward in (True, False):
        got = {r["i"]: r["x"] for r in asof.lookup(e, m, "t", "at", "id", "x", forward).collect()}
        for i, t in times:
            near = [x for x in real if t is not None and (x[0] >= t if forward else x[0] <= t)]
            want = (min(near)[1] if forward else max(near)[1]) if near else None
            assert got[i] == want, (i, t)


def test_ranges_hold_equal_shares_whatever_the_times(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 100)
    df = spark.range(5000).selectExpr("case when id = 4999 then 4000000000000000000 else id end as t", "id % 3 as k", "id")
    sizes = [r["count"] for r in ranges.in_ranges(df, "t").groupBy("__slot").count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 250 and sum(sizes) == 5000
    got = ranges.with_previous(df, ["k"], F.col("id"), ["t"]).collect()
    assert len(got) == 5000 and all(r["__last"] == (r["id"] - 3 if r["id"] >= 3 else None) and r["__first"] == (r["id"] < 3) for r in got)
    sums = ranges.with_running_sum(df, ["k"], F.lit(1), ["t"], "n").collect()
    assert all(r["n"] == r["id"] // 3 + 1 for r in sums)
    bounds = [1.0, 3.0, 3.5, 8.0, 9.0]
    xs = [-5.0, 0.0, 1.0, 2.0, 3.0, 3.4, 3.5, 7.0, 8.0, 9.0, 10.0]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select(ranges.place(F.col("x"), bounds)).collect()]
    assert found == [sum(b <= x for b in bounds) for x in xs] + [-1]


def test_next_id(spark):
    e = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3)], "i int, t long")
    one = spark.createDataFrame([(1, 1)], "at long, id int")
    assert [r["next_id"] for r in sorted(asof.next_id(e, one, "t", "at", "id").collect())] == [1, 1, 2, 2]
    assert {r["next_id"] for r in asof.next_id(e, one.where("false"), "t", "at", "id").collect()} == {1}


def test_long_pauses_and_distances(spark):
    many = spark.createDataFrame([(k * 1000, k * 1000 + k, k) for k in range(1, 101)], "start_us long, end_us long, duration long")
    assert asof.long_pauses(many, 90).count() == 10 and asof.long_pauses(many, 100).count() == 1 and asof.long_pauses(many, 0).count() == 100
    assert asof.long_pauses(many.where("false"), 90).count() == 0
    three = spark.createDataFrame([(1000, 1010, 10), (2000, 2020, 20), (3000, 3030, 30)], "start_us long, end_us long, duration long")
    e = spark.createDataFrame([(1, 3000, 4000), (2, 2900, 2999), (3, 100, 200), (4, None, 5), (5, 3100, 3101)], "i int, start_us long, end_us long")
    near = lambda c: sorted(r["i"] for r in filters.near_long_pauses(e, three, 90, c).collect())
    assert near(0) == [1] and near(31) == [1, 2] and near(100) == [1, 2, 5] and near(10_000) == [1, 2, 3, 5]
    assert filters.near_long_pauses(e, three.where("false"), 90, 10).count() == 0


def test_time_windows():
    t = datetime(2024, 1, 1)
    assert filters.TimeWindow(start=t, duration_s=60).bounds()[1] == datetime(2024, 1, 1, 0, 1)
    assert filters.TimeWindow(end=t, duration_s=60).bounds()[0] == datetime(2023, 12, 31, 23, 59)
    for bad in (filters.TimeWindow(duration_s=5), filters.TimeWindow(t, t, 5), filters.TimeWindow(t, datetime(2023, 1, 1)), filters.TimeWindow(t, duration_s=0)):
        with pytest.raises(ValueError):
            bad.bounds()


def test_filters(spark):
    df = spark.createDataFrame([("jdk.GarbageCollection", "a", "a"), ("jdk.CPULoad", "a", None), ("app.cpuload", None, None)], "event_type string, x string, y string")
    assert filters.like_types(df, ["*load"]).count() == 2 and filters.like_types(df, ["jdk.*"]).count() == 2 and filters.like_types(df, ["cpu?oad"]).count() == 2
    assert filters.without_idle_changes(df, "x", "y").count() == 1
    assert filters.of_types(df, ["JDK.cpuload"]).count() == 1
    with pytest.raises(ValueError, match="unknown event types nothing"):
        filters.of_types(df, ["nothing"])


def changed(rows, key, value):
    last, out = {}, []
    for r in rows:
        if key(r) not in last or last[key(r)] != value(r):
            out.append(r)
        last[key(r)] = value(r)
    return out


def test_dedup(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 3), rng.choice([None, 1, 2])) for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, name int, value int")
    assert sorted(map(tuple, dedup.changes(df, ["name"], ["value"], ["seq"]).collect())) == changed(rows, lambda r: r[1], lambda r: r[2])
    assert sorted(map(tuple, dedup.changes(df, [], ["value"], ["seq"]).collect())) == changed(rows, lambda r: 0, lambda r: r[2])
    per = df.withColumn("file", F.col("seq") % 2)
    got = dedup.changes(per, ["name"], ["value"], ["seq"], ["file"]).collect()
    assert sorted(tuple(r)[:3] for r in got) == changed(rows, lambda r: (r[0] % 2, r[1]), lambda r: r[2])
    assert {r["seq"] for r in dedup.first_of_each(df, ["name"], ["seq"]).collect()} == {min(r[0] for r in rows if r[1] == n) for n in {r[1] for r in rows}}
    assert dedup.changes(df.where("false"), [], ["value"], ["seq"]).count() == 0
    assert dedup.deduplicate(df, "jdk.BooleanFlag", ["seq"]).count() == len(changed(rows, lambda r: r[1], lambda r: r[2]))
    assert dedup.deduplicate(df, "jdk.Unknown", ["seq"]).count() == 300


def test_rules_are_those_of_the_reference(spark):
    singletons = "GCSurvivorConfiguration GCTLABConfiguration GCHeapConfiguration YoungGenerationConfiguration CPUInformation OSInformation JVMInformation VirtualizationInformation CodeCacheConfiguration CPUTimeStampCounter CompilerConfiguration"
    first = "ModuleRequire ModuleResolution ModuleExport DeprecatedInvocation"
    keyed = "InitialEnvironmentVariable InitialSystemProperty InitialSecurityProperty ActiveSetting JavaAgent NativeAgent"
    periodic = "NetworkUtilization CompilerQueueUtilization GCHeapMemoryPoolUsage NativeMemoryUsage NativeLibrary NativeLibraryLoad SystemProcess ThreadCPULoad ThreadAllocationStatistics CodeCacheStatistics"
    periodic_singletons = "DirectBufferStatistics NativeMemoryUsageTotal PhysicalMemory SwapSpace GCConfiguration ClassLoadingStatistics CompilerStatistics SymbolTableStatistics StringTableStatistics ResidentSetSize ExceptionStatistics GCHeapMemoryUsage CPULoad JavaMonitorStatistics"
    rules = dedup.RULES
    assert set(rules) == {*dedup.FLAGS, *" ".join([singletons, first, keyed, periodic, periodic_singletons]).split()}
    assert {t for t, r in rules.items() if r.periodic} == {*periodic.split(), *periodic_singletons.split()}
    assert {t for t, r in rules.items() if r.first_only} == {*first.split()}
    assert {t for t, r in rules.items() if not r.keys} == {*singletons.split(), *periodic_singletons.split()}
    loads = spark.createDataFrame([(k, k, k // 5 % 2, 1) for k in range(20)], "seq long, start_ns long, machineTotal int, jvmUser int")
    assert {r["seq"] for r in dedup.deduplicate(loads, "jdk.CPULoad", ["seq"]).collect()} == {0, 5, 10, 15}
    usage = spark.createDataFrame([(k, k, f"t{k % 2}", 1, k // 10) for k in range(20)], "seq long, start_ns long, type string, reserved long, committed long")
    assert {r["seq"] for r in dedup.deduplicate(usage, "jdk.NativeMemoryUsage", ["seq"]).collect()} == {0, 1, 10, 11}


def test_reductions(spark):
    sizes = [0, 8, 15, 16, 3, 2**50, -8, -3]
    df = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", reduce.aligned(F.col("s")).alias("c"))
    rows = df.select("s", "c", reduce.unaligned(F.col("c")).alias("again")).collect()
    assert all(r["s"] == r["again"] for r in rows) and {r["s"]: r["c"] for r in rows}[16] == 2
    ns = spark.createDataFrame([(v,) for v in (-(2**63), 2**63 - 1, 1_999_999, -1_999_999, 10**18)], "n long")
    assert [r[0] for r in ns.select(reduce.quantised_duration(F.col("n"), 1_000_000)).collect()] == [-(2**63), 2**63 - 1, 1_000_000, -1_000_000, 365 * 86_400 * 10**9]
    assert [r[0] for r in ns.select(reduce.quantised(F.col("n"), 1_000_000)).collect()][:1] == [-(2**63)]
    x = spark.createDataFrame([(1.0,), (3.14159265,), (None,), (float("nan"),)], "x double")
    got = [r[0] for r in x.select(reduce.bfloat16(F.col("x").cast("float"))).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(3.140625)
    assert [r[0] for r in x.select(reduce.float16("x")).collect()][1] == pytest.approx(3.140625)
    frames = spark.createDataFrame([([*"aXXXXbXXc"],), ([],), (["X"] * 3,)], "f array<string>")
    assert [r[0] for r in frames.select(reduce.collapsed(F.col("f"), lambda f: f == "X")).collect()] == [[*"aXXbXXc"], [], ["X", "X"]]


def test_expansion_gives_back_exact_combinations(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1, 2]), rng.choice(["a", None, "b"]), rng.randint(0, 5), rng.randint(0, 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "seq long, gcId int, name string, start_ns long, duration_ns long")
    spec = Combination("X", "gcId", ("name",), "structs", None, ("seq", "start_ns", "duration_ns"), exact=True)
    out = combine.expanded(combine.combined(df, spec), spec).select(*df.columns)
    assert out.exceptAll(df).count() == 0 and df.exceptAll(out).count() == 0
    lists = Combination("X", "gcId", ("name",), "list", "duration_ns", defaults={"stackTrace": None, "extra": 0})
    out = combine.expanded(combine.combined(df, lists), lists)
    key = ["gcId", "name", "duration_ns"]
    assert out.select(*key).exceptAll(df.select(*key)).count() == 0 and out.count() == 200 and {"stackTrace", "extra", "start_ns"} <= set(out.columns)
    assert combine.combined(df.where("false"), spec).count() == 0
    assert all(c.leaf in ("sum", "count", "list", "structs", "stats", "last") for c in COMBINATIONS.values()) and len(COMBINATIONS) >= 43


def test_large_keys_are_stored_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(combine, "CHUNK", 20)
    df = spark.range(400).selectExpr("id as seq", "id % 2 as gcId", "if(id < 300, 'a', null) as name", "id * 7 % 31 as start_ns", "id as duration_ns")
    spec = Combination("X", "gcId", ("name",), "structs", None, ("seq", "start_ns", "duration_ns"), exact=True)
    rows = combine.combined(df, spec)
    sizes = [r["n"] for r in rows.select(F.size("leaf").alias("n")).collect()]
    assert len(sizes) > 15 and max(sizes) < 60
    out = combine.expanded(rows, spec).select(*df.columns)
    assert out.exceptAll(df).count() == 0 and out.count() == 400
    assert {r["gcId"]: r["entries"] for r in combine.entry_counts(rows, spec).collect()} == {0: 2, 1: 2}


def test_combinations_of_presets():
    assert set(combine.BY_PRESET) == set(reduce.PRESETS)
    for preset, of in combine.BY_PRESET.items():
        assert all(combine.COMBINATIONS[key].event_type == t for t, key in of.items()), preset
    spec = COMBINATIONS["PromoteObjectInNewPLAB"]
    columns = ["gcId", "objectClass", "objectSize", "plabSize", "tenured", "tenuringAge", "eventThread", "start_ns", "seq"]
    assert spec.bound(columns).keys == spec.keys and spec.bound(["gcId"]) is None
    assert set(spec.bound(columns, lossless=True).fields) | {"gcId", "objectClass", "plabSize", "eventThread"} == set(columns)


def test_nested_fields_are_dropped_at_any_depth(spark):
    kind = "struct<truncated: boolean, frames: array<struct<method: struct<type: struct<name: string, package: string, modifiers: int>, name: string, descriptor: string, modifiers: int, hidden: boolean>, lineNumber: int, bytecodeIndex: int, type: string>>>"
    row = (1, (False, [((("C", "p", 1), "m", "()V", 2, False), 10, 20, "JIT")]), 5)
    df = spark.createDataFrame([row, (2, None, 6)], f"seq long, stackTrace {kind}, state int")
    out = reduce.reduced(df, reduce.PRESETS["reduced"], "jdk.ExecutionSample")
    assert out.columns == ["seq", "stackTrace"]
    frame = out.schema["stackTrace"].dataType["frames"].dataType.elementType
    assert frame.simpleString() == "struct<method:struct<type:struct<name:string,package:string>,name:string,descriptor:string>>"
    assert sorted((r["seq"], r["stackTrace"] is None) for r in out.collect()) == [(1, False), (2, True)]
    plain = reduce.reduced(df, reduce.PRESETS["lossless"], "jdk.ThreadPark")
    assert plain.schema == df.schema


def test_amounts_and_doubles_by_preset(spark):
    df = spark.createDataFrame([(1, 1000001, 1000001, 0.1)], "seq long, used long, other long, x double")
    df = df.withColumn("used", F.col("used").alias("used", metadata={"contentType": "DataAmount"}))
    got = reduce.reduced(df, reduce.Preset(short_amounts=True, double_bits=16)).first()
    assert got["used"] == 999424 and got["other"] == 1000001 and got["x"] == pytest.approx(0.1, abs=1e-4) and got["x"] != 0.1
