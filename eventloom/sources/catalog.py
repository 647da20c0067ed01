"""Event types by name: a table each, with labels of its fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: How views name the times of recorded events.
RECORDED = {"startTime": "start_ns", "endTime": "end_ns", "duration": "duration_ns"}
#: Types whose threads are always runnable, so that their state is not stored.
SAMPLED, RUNNABLE = ("ExecutionSample", "NativeMethodSample"), "STATE_RUNNABLE"


def _implied(event_type: str, rows: DataFrame) -> DataFrame:
    """rows with the state that their type implies, if it lacks one."""
    return rows.withColumn("state", F.lit(RUNNABLE)) if event_type.rpartition(".")[2] in SAMPLED and "state" not in rows.columns else rows


class Catalog:
    """Event types as DataFrames. A name is sought as it is, with a default package, by its simple name, and in any case."""

    def __init__(self, tables: dict[str, DataFrame], labels: dict[str, str] | None = None, package: str = "jdk.", order: tuple[str, str] = ("ts", "event_id"), names: dict[str, str] | None = None):
        """order: the columns of time and of the sequence of rows of one time. names: other names of columns, as views use them."""
        self.tables, self.labels, self.package, self.order, self.renamed = dict(tables), dict(labels or {}), package, order, dict(names or {})

    @classmethod
    def of_column(cls, events: DataFrame, types: list[str], column: str = "event_type") -> Catalog:
        """One table for each of the types of a single events table; filters on the column reach its scan."""
        return cls({t: events.where(F.col(column) == t) for t in types})

    @classmethod
    def of_folder(cls, spark: SparkSession, path: str) -> Catalog:
        """A folder with one Parquet table for each event type: <type>.parquet."""
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        listing = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(files)
        names = [s.getPath().getName() for s in listing]
        return cls({n.removesuffix(".parquet"): spark.read.parquet(f"{path}/{n}") for n in sorted(names) if n.endswith(".parquet")})

    @classmethod
    def of_recording(cls, recording, labels: dict[str, str] | None = None) -> Catalog:
        """The types of a recording (see sources.recording.Recording), in the order of their time; startTime and duration name its columns."""
        tables = {t: recording.events(t) for t in recording.types()}
        return cls(tables, {**recording.labels(), **(labels or {})}, order=("start_ns", "seq"), names=RECORDED)

    def names(self, event_type: str) -> list[str]:
        """The tables that a name means; several only if it is the simple name of types of different packages."""
        if event_type == "*":
            return list(self.tables)
        for name in (event_type, self.package + event_type):
            if name in self.tables:
                return [name]
        simple = [n for n in self.tables if n.rpartition(".")[2] == event_type]
        if simple:
            return simple
        return [n for n in self.tables if event_type.lower() in (n.lower(), n.rpartition(".")[2].lower())]

    def events(self, event_type: str) -> DataFrame:
        found = self.names_of(event_type)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_implied(n, self.tables[n]) for n in found])

    def names_of(self, event_type: str) -> list[str]:
        """names(), of which there must be one."""
        found = self.names(event_type) if event_type != "*" else list(self.tables)
        if not found:
            raise ValueError(f"unknown event type {event_type}; near: {', '.join(self.like(event_type))}")
        return found

    def marked(self, event_type: str) -> DataFrame:
        """events() with __type and __label: the full name of each row's type and its label. Of `*`, the time and sequence only."""
        if event_type == "*":
            parts = [df.select(*self.order, F.lit(n).alias("__type"), F.lit(self.label(n)).alias("__label")) for n, df in self.tables.items()]
            return reduce(lambda a, b: a.unionByName(b), parts)
        parts = [_implied(n, self.tables[n]).withColumns({"__type": F.lit(n), "__label": F.lit(self.label(n))}) for n in self.names_of(event_type)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def like(self, event_type: str, most: int = 10) -> list[str]:
        """Known names by edit distance, then name."""
        spark = SparkSession.active()
        known = spark.createDataFrame([(n,) for n in self.tables], "name string")
        return [r[0] for r in known.orderBy(F.levenshtein(F.lower("name"), F.lit(event_type.lower())), "name").limit(most).collect()]

    def label(self, event_type: str) -> str:
        return self.labels.get(event_type, event_type.rpartition(".")[2])

    def everything(self) -> DataFrame:
        """All types' rows in one table, with the columns event_type and event_label."""
        parts = [_implied(n, df).withColumns({"event_type": F.lit(n), "event_label": F.lit(self.label(n))}) for n, df in self.tables.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def listing(self, event_type: str, limit: int | None = None) -> DataFrame:
        """The events of a type by time, those without one first; limit: the first so many."""
        time, seq = self.order
        out = self.events(event_type).orderBy(F.col(time).asc_nulls_first(), F.col(seq).asc_nulls_first())
        return out if limit is None or limit < 0 else out.limit(limit)

    def metadata(self) -> DataFrame:
        """event_type, position, field, type, label and unit of every field."""
        rows = [(n, k, f.name, f.dataType.simpleString(), f.metadata.get("label"), f.metadata.get("unit")) for n, df in self.tables.items() for k, f in enumerate(df.schema)]
        return SparkSession.active().createDataFrame(rows, "event_type string, position int, field string, type string, label string, unit string")
