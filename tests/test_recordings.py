import os
import shutil

import pytest
from pyspark.sql import functions as F

from eventloom.sources import recording
from eventloom.sources.catalog import Catalog
from eventloom.streaming.recorder import Limits, Recorder, live_changes, live_combined, live_counts, live_first


@pytest.fixture(scope="module")
def tables(spark):
    pauses = spark.createDataFrame([(k, k * 1_000_000, k % 3, f"p{k % 2}", 5_000 * k, "t") for k in range(30)], "seq long, start_ns long, gcId long, name string, duration_ns long, eventThread string")
    flags = spark.createDataFrame([(k, k * 1_000_000 + 5, f"f{k % 2}", k // 8) for k in range(32)], "seq long, start_ns long, name string, value int")
    return {"GCPhasePause": pauses, "IntFlag": flags}


@pytest.mark.parametrize("preset", ["lossless", "default", "reduced", "gc-log"])
def test_round_trip(spark, tables, tmp_path, preset):
    recording.write(tables, f"{tmp_path}/r", preset)
    got = recording.Recording.open(spark, f"{tmp_path}/r")
    assert got.types() == ["GCPhasePause", "IntFlag"]
    pauses = got.events("GCPhasePause").select(*tables["GCPhasePause"].columns)
    assert pauses.exceptAll(tables["GCPhasePause"]).count() == 0 and pauses.count() == 30
    assert got.events("IntFlag").count() == 8
    assert got.span().first()["end_ns"] == 31 * 1_000_000 + 5 and got.span().first()["start_ns"] == 0
    assert {r["event_type"]: r["count"] for r in got.counts().collect()} == {"GCPhasePause": 30, "IntFlag": 8}
    assert all(r["intact"] for r in got.verify().collect()) and not any(r["truncated"] for r in got.damage().collect())
    raw = recording.Recording.open(spark, f"{tmp_path}/r", recording.Options().with_expansion(False)).events("GCPhasePause")
    assert raw.count() == 6 and "leaf" in raw.columns
    some = recording.Options().with_types(lambda t: t == "IntFlag").with_condition(F.col("value") > 1)
    assert recording.Recording.open(spark, f"{tmp_path}/r", some).events("IntFlag").count() == 4
    with pytest.raises(ValueError, match="no events of type X"):
        got.events("X")


@pytest.mark.parametrize("preset", ["lossless", "default", "reduced", "gc-log"])
def test_inputs_are_computed_once(spark, tmp_path, preset):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def of(*columns):
        rows = spark.range(200).selectExpr("id as seq", "id * 1000000 as start_ns", *columns)
        return rows.mapInArrow(counted, rows.schema)

    own = {
        "jdk.GarbageCollection": of("id div 10 as gcId", "id * 1000 as duration_ns"),
        "jdk.ZStatisticsCounter": of("id % 5 as id", "id as increment", "id * 3 as value"),
        "jdk.ObjectAllocationSample": of("concat('C', id % 3) as objectClass", "id as weight", "'s' as stackTrace", "'t' as eventThread"),
        "jdk.IntFlag": of("concat('f', id % 2) as name", "id div 8 as value"),
    }
    kept = spark.range(3).selectExpr("id as seq", "id as start_ns", "'f' as name", "id as value").persist()
    recording.write({**own, "jdk.LongFlag": kept}, f"{tmp_path}/r", preset)
    assert seen.value == 800
    assert all(df.storageLevel.useDisk is False for df in own.values()) and kept.storageLevel.useDisk
    kept.unpersist()
    got = recording.Recording.open(spark, f"{tmp_path}/r")
    assert got.events("jdk.ZStatisticsCounter").selectExpr("sum(value)").first()[0] == 3 * 199 * 100
    assert got.events("jdk.ObjectAllocationSample").selectExpr("sum(weight)").first()[0] == 199 * 100


def test_lossless_keeps_repeated_observations(spark, tables, tmp_path):
    loads = spark.createDataFrame([(k, k * 1_000_000, f"t{k % 2}", 0.5, 0.25) for k in range(20)], "seq long, start_ns long, eventThread string, user float, system float")
    memory = spark.createDataFrame([(k, k * 1_000_000, 64, 32) for k in range(20)], "seq long, start_ns long, totalSize long, usedSize long")
    own = {"ThreadCPULoad": loads, "jdk.PhysicalMemory": memory, "IntFlag": tables["IntFlag"]}
    for preset, counts in (("lossless", [20, 20, 8]), ("default", [2, 1, 8])):
        recording.write(own, f"{tmp_path}/{preset}", preset)
        got = recording.Recording.open(spark, f"{tmp_path}/{preset}")
        assert [got.events(t).count() for t in own] == counts
        if preset == "lossless":
            for t, rows in list(own.items())[:2]:
                assert got.events(t).select(*rows.columns).exceptAll(rows).count() == 0


def test_many_recordings_and_zip(spark, tables, tmp_path):
    later = {"IntFlag": tables["IntFlag"].withColumn("start_ns", F.col("start_ns") + 10**12)}
    recording.write(tables, f"{tmp_path}/a")
    recording.write(tables, f"{tmp_path}/b")  # the same start and configuration: left out
    recording.write(later, f"{tmp_path}/c")
    got = recording.Recording.open_many(spark, [f"{tmp_path}/{x}" for x in "cba"])
    assert got.events("IntFlag").count() == 16 and got.facts.count() == 2
    shutil.make_archive(f"{tmp_path}/z", "zip", tmp_path, "a")
    packed = recording.open_zip(spark, f"{tmp_path}/z.zip")
    assert packed.events("IntFlag").count() == 8 and packed.events("GCPhasePause").count() == 30 and packed.span().first()["start_ns"] == 0
    assert recording.Recording.open_folder(spark, f"{tmp_path}").events("IntFlag").count() == 16
    assert recording.zipped(spark, f"{tmp_path}/a/facts").count() == 0
    with pytest.raises(ValueError, match="unknown event types Nope"):
        recording.write(tables, f"{tmp_path}/d", types=["Nope"])


def test_each_recording_is_deduplicated_by_itself(spark, tables, tmp_path):
    later = tables["IntFlag"].withColumn("start_ns", F.col("start_ns") + 10**12)
    recording.write({"IntFlag": tables["IntFlag"]}, f"{tmp_path}/a", "lossless")
    recording.write({"IntFlag": later}, f"{tmp_path}/b", "lossless")
    both = recording.Recording.open_many(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert both.events("IntFlag").count() == 16
    recording.write({"IntFlag": both.events("IntFlag")}, f"{tmp_path}/ab", "lossless")
    again = recording.Recording.open(spark, f"{tmp_path}/ab").events("IntFlag")
    assert again.count() == 16  # the last values of one recording and the first of the next are both kept
    facts = both.summary().orderBy("path").collect()
    assert [(r["events"], r["types"], r["preset"], r["version"], r["compression"]) for r in facts] == [(8, 1, "lossless", 1, "zstd")] * 2
    both.inflate(f"{tmp_path}/plain", "json")
    assert spark.read.json(f"{tmp_path}/plain/IntFlag").count() == 16 and not both.is_empty("IntFlag")


def test_damage_is_found(spark, tables, tmp_path):
    recording.write({"IntFlag": tables["IntFlag"].repartition(3)}, f"{tmp_path}/r", "lossless")
    (first, *_) = sorted(p for p in os.listdir(f"{tmp_path}/r/events/IntFlag") if p.endswith(".parquet"))
    with open(f"{tmp_path}/r/events/IntFlag/{first}", "r+b") as f:
        f.truncate(40)
    os.remove(f"{tmp_path}/r/events/IntFlag/.{first}.crc")
    got = recording.Recording.open(spark, f"{tmp_path}/r")
    (row,) = got.damage().collect()
    assert row["truncated"] and row["found_rows"] < row["stored_rows"] == 8 and not got.verify().first()["intact"]


def test_flame_page(spark, tables):
    from eventloom.operators import summary

    tree = summary.byte_tree(tables["IntFlag"].withColumn("event_type", F.lit("Int<Flag>")), ["name"])
    page = summary.flame_html(tree, ["event_type", "name"])
    assert "Int&lt;Flag&gt;" in page and page.count("<li") == 3 and "100.00%" in page and "32 rows" in page


def test_sinks(spark, tables, tmp_path):
    rows = tables["IntFlag"].limit(2)
    assert recording.as_json(rows).first()["value"].startswith('{"seq":') and "<seq>" in recording.as_xml(rows).first()["value"]
    assert "  value = 0" in recording.as_text(rows, "IntFlag").first()["value"]
    recording.write_csv(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    assert recording.row_digest(tables["IntFlag"]).first() == recording.row_digest(tables["IntFlag"].orderBy(F.rand(1))).first()


def test_catalog(spark, tables, tmp_path):
    cat = Catalog({"jdk.A": tables["IntFlag"], "app.B": tables["IntFlag"], "x.B": tables["GCPhasePause"]}, {"jdk.A": "Letter A"})
    assert cat.names("A") == ["jdk.A"] and cat.names("B") == ["app.B", "x.B"] and cat.names("a") == ["jdk.A"] and cat.events("B").count() == 62
    assert cat.label("jdk.A") == "Letter A" and cat.metadata().where("event_type = 'jdk.A'").count() == 4
    with pytest.raises(ValueError, match="near: jdk.A"):
        cat.events("jdk.AA")
    tables["IntFlag"].write.parquet(f"{tmp_path}/t/jdk.Flag.parquet")
    assert Catalog.of_folder(spark, f"{tmp_path}/t").events("Flag").count() == 32


@pytest.fixture()
def stream(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    for k, name in enumerate(sorted(n for n in os.listdir(f"{tmp_path}/in") if n.endswith(".parquet"))):
        os.utime(f"{tmp_path}/in/{name}", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by their times
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def test_rotation_and_retention(spark, stream, tmp_path):
    recorder = Recorder(f"{tmp_path}/rec", Limits(max_batches=1))
    recorder.start(stream, f"{tmp_path}/ck", once=True).awaitTermination()
    assert recorder.folders(spark) == [f"{k:08d}" for k in range(4)] and recorder.read(spark).count() == 1000
    assert recorder.status()["state"] == "stopped"
    kept = Recorder(f"{tmp_path}/rec2", Limits(max_bytes=1024, max_folders=2))
    kept.start(stream, f"{tmp_path}/ck2", once=True).awaitTermination()
    assert kept.folders(spark) == ["00000002", "00000003"]
    kept.change(max_folders=1)
    assert kept.limits.max_folders == 1
    for bad in ({"max_bytes": 10}, {"max_batches": 0}, {"max_folders": 0}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_a_repeated_batch_is_stored_once(spark, stream, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    recorder = Recorder(f"{tmp_path}/twice", Limits(max_bytes=1024), pattern="$date")
    for number in (0, 1, 1, 2, 0, 2):  # a batch that fills a folder, and those before, run again
        recorder._store(rows.limit(500), number)
    assert recorder.read(spark).count() == 1500 and len(recorder.folders(spark)) == 3
    timed = Recorder(f"{tmp_path}/timed", Limits(max_seconds=0.001))
    timed._store(rows.limit(5), 0)
    timed._store(rows.limit(5), 1)
    assert timed.folders(spark) == ["00000000", "00000001"]


def test_a_recording_ends_after_its_duration(spark, stream, tmp_path):
    recorder = Recorder(f"{tmp_path}/short", Limits(duration_s=15))
    recorder.start(stream, f"{tmp_path}/ck3")
    assert recorder.status()["state"] == "running" and recorder.query.awaitTermination(60)
    assert recorder.status()["state"] == "stopped" and recorder.read(spark).count() == 1000


def run(spark, df, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/m").trigger(availableNow=True).start().awaitTermination()
    return spark.table("out")


def test_live_counts(spark, stream, sf_dir, tmp_path):
    got = run(spark, live_counts(stream, "ts", "1 day", "1 hour"), tmp_path, "complete")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("count"))
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_live_combined_and_first(spark, stream, tmp_path):
    got = run(spark, live_combined(stream, "ts", "1 day", "1 hour", ["event_type"], "value"), tmp_path, "complete")
    assert got.agg(F.sum("count")).first()[0] == 1000
    first = run(spark, live_first(stream, "ts", "400 days", ["event_type"]), f"{tmp_path}/b")
    assert first.count() == 5


def test_live_changes(spark, stream, sf_dir, tmp_path):
    try:
        got = {r["event_id"] for r in run(spark, live_changes(stream, "user_id", "event_type", "ts"), tmp_path).collect()}
    finally:
        spark.catalog.dropTempView("out")
    rows, last, want = sorted(spark.read.parquet(f"{sf_dir}/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"])), {}, set()
    for r in rows:
        if last.get(r["user_id"]) != r["event_type"]:
            want.add(r["event_id"])
        last[r["user_id"]] = r["event_type"]
    assert got == want
