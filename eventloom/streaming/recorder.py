"""Live recordings: event streams stored in rotating folders with limits, and streaming forms of summaries and deduplication."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Limits:
    """When a recording's folder is full, how many are kept, and when it ends. They can be changed while it runs."""

    max_bytes: int | None = None
    max_batches: int | None = None
    max_folders: int | None = None
    #: Seconds from the first batch of a folder to its last, and of the whole recording.
    max_seconds: float | None = None
    duration_s: float | None = None

    def __post_init__(self):
        if self.max_bytes is not None and self.max_bytes < 1024:
            raise ValueError("the size must be 1 kB or more")
        if self.max_batches is not None and self.max_batches < 1:
            raise ValueError("a folder takes one batch or more")
        if self.max_folders is not None and self.max_folders < 1:
            raise ValueError("one folder or more must be kept")
        if self.max_seconds is not None and self.max_seconds < 0.001:
            raise ValueError("a folder takes a millisecond or more")
        if self.duration_s is not None and self.duration_s <= 0:
            raise ValueError("a duration must be positive")


class Recorder:
    """Stores a stream in folders that are full by size, batches or time, and deletes the oldest beyond the limit.

    Folders lie below the path and begin with their number, of the first batch in them; a batch that is run again after a
    failure writes over what it has written, wherever that is, so that no event is stored twice.
    """

    def __init__(self, path: str, limits: Limits = Limits(), pattern: str = "$index"):
        """pattern: a folder's name after its number; $index is that number, $date when it was begun."""
        self.path, self.limits, self.query, self.pattern = path, limits, None, pattern

    def _fs(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self, spark: SparkSession) -> list[str]:
        jvm, fs = self._fs(spark)
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def _name(self, number: int) -> str:
        index = f"{number:08d}"
        if self.pattern == "$index":
            return index
        return f"{index}-" + self.pattern.replace("$index", index).replace("$date", datetime.now(timezone.utc).strftime("%Y-%m-%d_%H-%M-%S"))

    def _place(self, spark: SparkSession, number: int) -> str:
        """The folder of a batch: the one that has it already, else the last one if it is not full, else a new one."""
        jvm, fs = self._fs(spark)
        at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        there = self.folders(spark)
        written = [name for name in there if fs.exists(at(name, f"batch={number}"))]
        if written:
            return written[-1]
        if not there:
            return self._name(number)
        last = there[-1]
        held, limits = int(last[:8]), self.limits
        size = fs.getContentSummary(at(last)).getLength()
        age = time.time() - fs.getFileStatus(at(last, f"batch={held}")).getModificationTime() / 1000 if limits.max_seconds is not None and fs.exists(at(last, f"batch={held}")) else 0
        full = (
            (limits.max_batches is not None and number - held >= limits.max_batches)
            or (limits.max_bytes is not None and size >= 0.9 * limits.max_bytes)
            or (limits.max_seconds is not None and age >= limits.max_seconds)
        )
        return self._name(number) if full and number > held else last

    def _store(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.path}/{self._place(spark, number)}/batch={number}")
        if self.limits.max_folders is not None:
            jvm, fs = self._fs(spark)
            for name in self.folders(spark)[: -self.limits.max_folders]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def start(self, events: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Starts to store a stream, for limits.duration_s if that is set; once: what is there now only."""
        writer = events.writeStream.foreachBatch(self._store).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer).start()
        if self.limits.duration_s is not None:
            timer = threading.Timer(self.limits.duration_s, self.query.stop)
            timer.daemon = True
            timer.start()
        return self.query

    def change(self, **limits) -> None:
        self.limits = replace(self.limits, **limits)

    def status(self) -> dict:
        if self.query is None:
            return {"state": "not started"}
        return {"state": "running" if self.query.isActive else "stopped", "batch": (self.query.lastProgress or {}).get("batchId")}

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def read(self, spark: SparkSession) -> DataFrame:
        """All stored events of the folders that are there now, without those that a batch is still writing."""
        return spark.read.option("recursiveFileLookup", True).parquet(*[f"{self.path}/{n}" for n in self.folders(spark)])


def live_counts(events: DataFrame, time: str, width: str, late: str, event_type: str = "event_type") -> DataFrame:
    """Events of each type in tumbling windows; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), event_type).agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("start"), event_type, "count")


def live_combined(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Sums and counts of a value by key in tumbling windows: bounded state in the place of a cache of open groups."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), *keys, "count", "sum", "max")


def live_first(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark's reach."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def live_changes(events: DataFrame, key: str, compared: str, time: str) -> DataFrame:
    """Events whose compared field differs from the same key's event before, over the whole stream."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[compared].dataType.simpleString()
    names = events.columns

    def step(_, parts, state: GroupState):
        rows = pd.concat(list(parts)).sort_values(time, kind="stable")
        (last, seen) = state.get if state.exists else (None, False)
        keep = []
        for v in rows[compared]:
            same = seen and (v == last or (pd.isna(v) and last is None))
            keep.append(not same)
            last, seen = (None if pd.isna(v) else v), True
        state.update((last, seen))
        yield rows[keep][names]

    return events.groupBy(key).applyInPandasWithState(step, events.schema, f"last {kind}, seen boolean", "append", GroupStateTimeout.NoTimeout)


def drained(events: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a stream gives for the input that is there now, written below a path and read as a table.

    mode: append keeps the rows of all batches, complete those of the last one. A batch that runs again writes over itself.
    """
    spark = events.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    events.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")
