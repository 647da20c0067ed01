"""Recordings: folders of Parquet tables with facts about them, read one by one or joined, and the sinks of events."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.formatting import iso
from eventloom.functions.parsing import MOST_NS
from eventloom.operators.asof import next_id
from eventloom.operators.combine import BY_PRESET, COMBINATIONS, Combination, combined, expanded, floor_power_of_two, from_residuals, packed_age, residuals, unpacked_age
from eventloom.operators.dedup import deduplicate
from eventloom.operators.filters import without_idle_changes
from eventloom.operators.reduce import PRESETS, Preset, is_negligible, reduced
from eventloom.sources.shared import holding

ORDER = ("start_ns", "seq")
VERSION = 1
#: What is known of each type of a recording. combination: the bound combination as JSON; schema: that of the events that it gives back.
NOTES = "event_type string, name string, combination string, schema string, stored_schema string, label string, rows long, start_ns long, end_ns long, stored_rows long, digest long"
#: Types whose pauses a preset may leave out if they are too short.
PAUSES = ("GCPhasePause", "GCPhasePauseLevel1", "GCPhasePauseLevel2", "GCPhasePauseLevel3", "GCPhasePauseLevel4")


@dataclass(frozen=True)
class Options:
    """How recordings are read: expand combined types or not, which types, and which events."""

    expand: bool = True
    types: Callable[[str], bool] | None = None
    condition: Column | None = None

    def with_expansion(self, expand: bool) -> Options:
        return replace(self, expand=expand)

    def with_types(self, types: Callable[[str], bool]) -> Options:
        return replace(self, types=types)

    def with_condition(self, condition: Column) -> Options:
        return replace(self, condition=condition)


class Recording:
    """Events of one or several recordings in the columns of their types, with recording_id, the path that they come from."""

    def __init__(self, parts: dict[str, list[tuple[str, DataFrame, T.Row]]], facts: DataFrame, notes: DataFrame, options: Options = Options()):
        """parts: of each type its stored table in each recording, with the path and the note of it."""
        self.parts, self.facts, self.notes, self.options = parts, facts, notes, options

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options = Options()) -> Recording:
        """A folder that write() has left. Files that are cut short are passed over; damage() tells what lacks."""
        return cls.open_many(spark, [path], options)

    @classmethod
    def open_folder(cls, spark: SparkSession, folder: str, options: Options = Options()) -> Recording:
        """All recordings that lie in a folder, not below its subfolders."""
        return cls.open_many(spark, [p for p in children(spark, folder) if "facts" in [q.rpartition("/")[2] for q in children(spark, p)]], options)

    @classmethod
    def open_many(cls, spark: SparkSession, paths: list[str], options: Options = Options()) -> Recording:
        """Several recordings by start; of those with the same start and configuration, the first path counts. Presets must agree."""
        if not paths:
            raise ValueError("no recording")
        read = spark.read.option("ignoreCorruptFiles", True)
        facts = reduce(DataFrame.unionByName, [read.parquet(f"{p}/facts").withColumn("path", F.lit(p)) for p in paths])
        first = facts.groupBy("start_ns", "config").agg(F.min_by(F.struct("path", "version"), "path").alias("p")).select("p.*", "start_ns").orderBy("start_ns", "path")
        chosen = first.collect()  # a row for each path
        if len({r["version"] for r in chosen}) > 1:
            raise ValueError("recordings of different versions")
        keep = [r["path"] for r in chosen]
        notes = reduce(DataFrame.unionByName, [spark.read.schema(NOTES).parquet(f"{p}/types").withColumn("path", F.lit(p)) for p in keep])
        parts: dict[str, list] = {}
        for note in sorted(notes.collect(), key=lambda r: (keep.index(r["path"]), r["event_type"])):  # a row for each type of a path
            if options.types is None or options.types(note["event_type"]):
                stored = spark.read.option("ignoreCorruptFiles", True).schema(_schema(note["stored_schema"])).parquet(f"{note['path']}/events/{note['name']}")
                parts.setdefault(note["event_type"], []).append((note["path"], stored, note))
        return cls(parts, facts.where(F.col("path").isin(*keep)), notes, options)

    def events(self, event_type: str) -> DataFrame:
        """The events of a type; combined ones are expanded unless the options say otherwise."""
        if event_type not in self.parts:
            raise ValueError(f"no events of type {event_type}; there are {', '.join(sorted(self.parts)[:10])}")
        tables = []
        for path, stored, note in self.parts[event_type]:
            rows = restored(stored, note) if self.options.expand else stored
            tables.append(rows.withColumn("recording_id", F.lit(path)))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        return rows if self.options.condition is None else rows.where(self.options.condition)

    def types(self) -> list[str]:
        return sorted(self.parts)

    def labels(self) -> dict[str, str]:
        return {t: note["label"] for t, own in self.parts.items() for _, _, note in own if note["label"]}

    def span(self) -> DataFrame:
        """One row: first start, last end and duration of the recordings, without a look at their events."""
        return self.facts.agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), (F.max("end_ns") - F.min("start_ns")).alias("duration_ns"))

    def counts(self) -> DataFrame:
        """event_type and count, from what write() has noted."""
        return self.notes.groupBy("event_type").agg(F.sum("rows").alias("count"))

    def summary(self) -> DataFrame:
        """A row for each recording: path, version, config, preset, compression, start, end, duration, events and types."""
        own = self.notes.groupBy("path").agg(F.sum("rows").alias("events"), F.count(F.lit(1)).alias("types"))
        return self.facts.join(own, "path", "left").withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))

    def is_empty(self, event_type: str) -> bool:
        return self.events(event_type).isEmpty()

    def damage(self) -> DataFrame:
        """path, event_type, stored_rows, found_rows and truncated: which tables have lost rows, by the counts in their files."""
        found = [stored.agg(F.count(F.lit(1)).alias("found_rows")).withColumns({"path": F.lit(p), "event_type": F.lit(t)}) for t, own in self.parts.items() for p, stored, _ in own]
        both = self.notes.join(reduce(DataFrame.unionByName, found), ["path", "event_type"])
        return both.select("path", "event_type", "stored_rows", "found_rows", (F.col("found_rows") < F.col("stored_rows")).alias("truncated"))

    def verify(self) -> DataFrame:
        """path, event_type and intact: whether each stored table still has the rows and the digest that write() has noted."""
        found = [row_digest(stored).withColumns({"path": F.lit(p), "event_type": F.lit(t)}) for t, own in self.parts.items() for p, stored, _ in own]
        both = self.notes.select("path", "event_type", "stored_rows", F.col("digest").alias("noted")).join(reduce(DataFrame.unionByName, found), ["path", "event_type"])
        return both.select("path", "event_type", ((F.col("rows") == F.col("stored_rows")) & F.col("digest").eqNullSafe(F.col("noted"))).alias("intact"))

    def inflate(self, path: str, form: str = "parquet") -> None:
        """Writes the events as they were, a folder for each type, as parquet, json, orc or csv."""
        for t in self.types():
            self.events(t).write.format(form).save(f"{path}/{t}")


def children(spark: SparkSession, folder: str) -> list[str]:
    """The paths in a folder of any file system that Spark knows, in order; none if there is no such folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f"{folder.rstrip('/')}/{s.getPath().getName()}" for s in fs.listStatus(root)) if fs.exists(root) and fs.getFileStatus(root).isDirectory() else []


def collections_of(tables: dict[str, DataFrame]) -> DataFrame | None:
    """gcId and at: when each collection is first heard of, by any type that names it; None if none does."""
    named = [df.select(F.col("gcId").cast("long").alias("gcId"), F.col("start_ns").alias("at")) for df in tables.values() if {"gcId", "start_ns"} <= set(df.columns)]
    return reduce(DataFrame.union, named).where("gcId is not null and at is not null").groupBy("gcId").agg(F.min("at").alias("at")) if named else None


def prepared(rows: DataFrame, spec: Combination, marks: DataFrame | None) -> DataFrame:
    """rows with what a combination needs: the id of the next collection, the packed age, the residual."""
    if spec.group == "nextGCId" and "nextGCId" not in rows.columns:
        rows = rows.withColumn("nextGCId", F.lit(1).cast("long")) if marks is None else next_id(rows, marks, "start_ns", "at", "gcId", "nextGCId")
    if "packedAge" in spec.keys:
        rows = rows.withColumn("packedAge", packed_age(F.col("tenured"), F.col("tenuringAge")))
    if "residual" in spec.fields:
        rows = residuals(rows, "id", "value", "increment", ORDER)
    if spec.leaf == "sum" and "plabSize" in spec.keys:
        rows = rows.withColumn("plabSize", floor_power_of_two(F.col("plabSize")))
    return rows


def restored(stored: DataFrame, note: T.Row) -> DataFrame:
    """The events of a stored table, in the columns that they had; those that a combination has not kept are null."""
    schema, rows = _schema(note["schema"]), stored
    if note["combination"] is not None:
        spec = bound_from(note["combination"])
        rows = expanded(stored, spec)
        if "packedAge" in spec.keys:
            tenured, age = unpacked_age(F.col("packedAge"))
            rows = rows.withColumns({"tenured": tenured, "tenuringAge": age})
        if "residual" in spec.fields:
            rows = from_residuals(rows, "id", "increment", ORDER)
        if spec.leaf == "stats":  # there is no event to give back, only what is known of them
            return rows
    there = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name, metadata=f.metadata) for f in schema])


def _schema(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def bound_from(text: str) -> Combination:
    found = json.loads(text)
    return replace(COMBINATIONS[found["of"]], **{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k != "of"})


def _kept(rows: DataFrame, event_type: str, preset: Preset, name: str) -> DataFrame:
    """Without events that say nothing, repeated ones (in each input file by itself) and, if the preset says so, very short pauses."""
    simple = event_type.rpartition(".")[2]
    if preset.ignore_unnecessary:
        if simple == "G1HeapRegionTypeChange" and {"from", "to"} <= set(rows.columns):
            rows = without_idle_changes(rows, "from", "to")
        rows = deduplicate(rows, event_type, list(ORDER), ["recording_id"] if "recording_id" in rows.columns else None, periodic=name != "lossless")
    if preset.ignore_short_pauses and simple in PAUSES and "duration_ns" in rows.columns:
        rows = rows.where(~F.coalesce(is_negligible(F.col("duration_ns"), preset.duration_tick_ns), F.lit(False)))
    return rows


def write(
    tables: dict[str, DataFrame], path: str, preset: str = "default", config: str = "", types: list[str] | None = None, compression: str = "zstd", labels: dict[str, str] | None = None, presets: dict[str, Preset] = PRESETS
) -> None:
    """Stores event tables as a recording: deduplicated, reduced and combined as the preset says, a folder for each type.

    tables have start_ns and seq; with recording_id (see Recording) repeated events are sought in each recording by itself.
    'lossless' keeps every observation of periodic types and combines exactly. types: only these; one that is not there is an error.
    compression: none, gzip, lz4 or zstd, as Parquet knows them. Combined types are grouped by their collection or the next one that any
    type names. What is stored is noted in `types` and `facts`, by which it can be listed, checked and read without its events.
    Each table is computed once, and kept on the executors' disks until all is written.
    """
    if types is not None:
        missing = sorted(set(types) - set(tables))
        if missing:
            raise ValueError(f"unknown event types {', '.join(missing)}; there are {', '.join(sorted(tables)[:10])}")
    chosen, spark = presets[preset], next(iter(tables.values())).sparkSession
    with holding() as hold:
        tables = {t: hold(df) if types is None or t in types else df for t, df in tables.items()}
        marks = collections_of(tables)
        marks = None if marks is None else hold(marks)
        notes = [_stored(t, rows, path, preset, chosen, marks, compression, (labels or {}).get(t)) for t, rows in tables.items() if types is None or t in types]
        plain = spark.createDataFrame(notes, "event_type string, name string, combination string, schema string, stored_schema string, label string")
        known = [_noted(spark.read.parquet(f"{path}/events/{n['name']}"), n) for n in plain.collect()]
        written = plain.join(reduce(DataFrame.unionByName, known), "event_type")
        written.select(*[f.split()[0] for f in NOTES.split(", ")]).write.parquet(f"{path}/types")
        spans = [df.agg(F.min("start_ns").alias("start_ns"), F.max(_end(set(df.columns))).alias("end_ns")) for t, df in tables.items() if types is None or t in types]  # of repeated events too
        facts = reduce(DataFrame.union, spans).agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
        facts.withColumns({"config": F.lit(config), "preset": F.lit(preset), "compression": F.lit(compression), "version": F.lit(VERSION)}).write.parquet(f"{path}/facts")


def _stored(t: str, rows: DataFrame, path: str, preset: str, chosen: Preset, marks: DataFrame | None, compression: str, label: str | None) -> tuple:
    """Writes a type's events and gives what is to be noted of them. Rows that were dealt by time are read by several jobs, so they are held."""
    simple = t.rpartition(".")[2]
    kept = _kept(rows, t, chosen, preset)
    rows = reduced(kept, chosen, t)
    of = BY_PRESET.get(preset, {}).get(simple)
    spec = COMBINATIONS[of].bound([c for c in rows.columns if c != "recording_id"], preset == "lossless", chosen.ignore_zero_ages) if of else None
    text, name, out = None, t, rows
    with holding() as hold:
        if spec is not None:
            if spec.group == "nextGCId":  # by the times as they are, before they are cut to ticks
                rows = hold(reduced(prepared(kept, Combination(t, "nextGCId"), marks), chosen, t))
            ready = prepared(rows, spec, marks)
            name, out = f"{t}+{of}", combined(hold(ready) if "residual" in spec.fields else ready, spec)
            text = json.dumps({"of": of, **{k: v for k, v in asdict(spec).items() if k in ("group", "keys", "leaf", "value", "fields", "exact")}})
        out.write.option("compression", compression).parquet(f"{path}/events/{name}")
    own = rows.drop("recording_id", "nextGCId") if spec else rows
    return t, name, text, own.schema.json(), out.schema.json(), label


def _end(columns: set[str]) -> Column:
    """When an event ends: at its end, or its start and duration, as its columns tell; endless ones where they start."""
    if "start_ns" not in columns:
        return F.lit(None).cast("long")
    if "end_ns" in columns:
        return F.coalesce(F.col("end_ns"), F.col("start_ns"))
    length = F.col("duration_ns").cast("long") if "duration_ns" in columns else F.lit(0)
    return F.col("start_ns") + F.when(length.between(0, MOST_NS), length).otherwise(0)


def _noted(stored: DataFrame, note: T.Row) -> DataFrame:
    """One row about a stored table: events, first start, last end, stored rows and their digest."""
    rows = restored(stored, note)
    have = set(rows.columns)
    start = F.col("start_ns") if "start_ns" in have else F.lit(None).cast("long")
    number = F.coalesce(F.sum("count"), F.lit(0)) if note["combination"] is not None and bound_from(note["combination"]).leaf == "stats" else F.count(F.lit(1))
    events = rows.agg(number.alias("rows"), F.min(start).alias("start_ns"), F.max(_end(have)).alias("end_ns"))
    held = row_digest(stored).withColumnRenamed("rows", "stored_rows")
    return events.crossJoin(held).withColumn("event_type", F.lit(note["event_type"]))  # one row each


def zipped(spark: SparkSession, path: str) -> DataFrame:
    """archive, member and size of the files in ZIP archives, which are known by their first bytes; other files are left out.

    path: a file or pattern of any file system that Spark knows. Each archive is opened by one task; Spark takes up to 2 GB.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        members = [i for i in z.infolist() if not i.is_dir()]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(members)), pa.array([m.filename for m in members], pa.string()), pa.array([m.file_size for m in members], pa.int64())], names=["archive", "member", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, size long")


def zipped_table(spark: SparkSession, path: str, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of the Parquet files below a folder inside ZIP archives, read by the tasks that open the archives: nothing is unpacked."""
    names, prefix = schema.names, folder.strip("/") + "/"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (raw,) in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw[:4] != b"PK\x03\x04":
                    continue
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for member in sorted(n for n in z.namelist() if n.startswith(prefix) and n.endswith(".parquet")):
                        yield from pq.ParquetFile(io.BytesIO(z.read(member))).iter_batches(columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, columns)


def open_zip(spark: SparkSession, path: str, options: Options = Options()) -> Recording:
    """The recordings in a ZIP archive."""
    members = [r["member"] for r in zipped(spark, path).select("member").collect()]  # names of files only
    roots = sorted({m.rpartition("/facts/")[0] for m in members if "/facts/" in f"/{m}" and m.endswith(".parquet")})
    if not roots:
        raise ValueError(f"no recording in {path}")
    types, kinds = T._parse_datatype_string(NOTES), T._parse_datatype_string("start_ns long, end_ns long, config string, preset string, compression string, version int")
    parts, facts, notes = {}, [], []
    for root in roots:
        of, known = f"{path}!/{root}", zipped_table(spark, path, f"{root}/types", types)
        facts.append(zipped_table(spark, path, f"{root}/facts", kinds).withColumn("path", F.lit(of)))
        notes.append(known.withColumn("path", F.lit(of)))
        for note in known.collect():
            if options.types is None or options.types(note["event_type"]):
                parts.setdefault(note["event_type"], []).append((of, zipped_table(spark, path, f"{root}/events/{note['name']}", _schema(note["stored_schema"])), note))
    return Recording(parts, reduce(DataFrame.unionByName, facts), reduce(DataFrame.unionByName, notes), options)


def json_ready(events: DataFrame) -> DataFrame:
    """events as JSON shows them: times as ISO text, and null for whole numbers that their description says mean none."""
    out = {}
    for f in events.schema:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = iso(F.col(f.name))
        elif isinstance(f.dataType, T.IntegerType) and "minimum value for the type int" in str(f.metadata.get("description", "")):
            out[f.name] = F.nullif(F.col(f.name), F.lit(-(2**31)))
    return events.withColumns(out) if out else events


def as_json(events: DataFrame, nulls: bool = False) -> DataFrame:
    """One column `value`: each event as a JSON object (see json_ready); nulls are left out unless `nulls`."""
    return json_ready(events).select(F.to_json(F.struct(*events.columns), {"ignoreNullFields": str(not nulls).lower()}).alias("value"))


def as_xml(events: DataFrame) -> DataFrame:
    return events.select(F.to_xml(F.struct(*events.columns)).alias("value"))


def as_text(events: DataFrame, event_type: str) -> DataFrame:
    """One column `value`: the type's name and each field with its value on lines of their own."""
    lines = [F.concat(F.lit(f"  {f.name} = "), F.coalesce(F.col(f.name).cast("string") if f.dataType.simpleString() not in ("void",) and not f.dataType.simpleString().startswith(("struct", "array", "map")) else F.to_json(f.name), F.lit("N/A"))) for f in events.schema]
    return events.select(F.concat(F.lit(event_type + " {\n"), F.concat_ws("\n", *lines), F.lit("\n}")).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def row_digest(events: DataFrame) -> DataFrame:
    """One row: how many events there are and a digest that does not depend on their order."""
    return events.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*events.columns)).alias("digest"))
