"""What the corpus operators share: the shared folder, Arrow batches and vectorised word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


#: Bytes that Spark hands to a Python worker at once; its own default counts rows only, however long they are.
ARROW_BYTES = "8388608"


def bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares. Where none is set, as in tests, one of this machine, and on one machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        top = tempfile.mkdtemp(prefix="eventloom-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back, so that lost executors cost no recomputation of what led to it."""
    return stored_at(df, shared_dir(df.sparkSession))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a path, which is deleted at the end of the application at the latest."""
    spark = df.sparkSession
    bounded(spark)
    df.write.option("compression", "zstd").parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Intermediate tables of this process that have not been deleted.
MADE: list[str] = []


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the intermediate tables that are made within, but for those whose paths are added to the list that it gives."""
    before, keep = set(MADE), []
    try:
        yield keep
    finally:
        for path in [p for p in MADE if p not in before and p not in keep]:
            forget(spark, path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table of which nothing is needed any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if path in MADE:
        MADE.remove(path)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is not in ids (one column, any name); rows with a null id stay. Texts are compressed on the way."""
    names, schema = docs.columns, docs.schema
    place = names.index(text)
    packed = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in schema)

    def recode(change, kind):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                new = pa.array([None if t is None else change(t) for t in batch.column(place).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([new if k == place else c for k, c in enumerate(batch.columns)], names=names)

        return run

    small = docs.mapInArrow(recode(lambda t: zstandard.ZstdCompressor(level=3).compress(t.encode()), pa.binary()), packed)
    gone = unused(docs, "gone")
    ids = ids.toDF(gone).where(F.col(gone).isNotNull()).distinct()
    left = small.join(ids, small[id_col] == ids[gone], "left_anti")
    return left.mapInArrow(recode(lambda z: zstandard.ZstdDecompressor().decompress(z).decode(), pa.string()), schema)


#: Into how many parts a key of a skewed join is dealt.
SALTS = 16


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted(rows: DataFrame, side: DataFrame, key: str, by: list[str]) -> DataFrame:
    """rows left-joined by key to side, which has one row a key: a key's rows are dealt by the columns `by` to SALTS places.

    Each row of side goes to all places of its key, so that a key that a third of all rows have is not in one task. Rows with a
    null key stay, with nulls. Columns of rows and side must differ but for the key.
    """
    salt = unused(rows, "salt")
    own = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    each = side.where(F.col(key).isNotNull()).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.join(each, [key, salt], "left").drop(salt)


#: What a Python worker keeps between tasks, to be dropped when it turns to other work.
KEPT: list[dict] = []


def release(kept: bool = True) -> None:
    """Gives memory that is free back to the system, as a worker shares it with its executor; kept: also what is in KEPT."""
    if kept:
        for each in KEPT:
            each.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4_000_000, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the bytes of a column stay below `most`, unless a single row has more. keep: KEPT is in use."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > begin and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)
        release(not keep)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers, _inverse = (np.array([1, *[b] * (size - 1)], dtype=np.uint64).cumprod(dtype=np.uint64) for b in (BASE, BASE_INV))
    return _powers[:n], _inverse[:n]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[start:end]; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of many texts as hashes: `hashes` of all words, and `first[i]:first[i + 1]` those of text i."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        """Words are runs of bytes other than space and \\t \\n \\v \\f \\r; A-Z count as a-z if `lower`. A null text has none."""
        arr = texts.cast(pa.large_binary())
        offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + arr.offset + 1)[arr.offset :]
        data = np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(arr) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if lower:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        opens, closes = inside.copy(), np.zeros(len(data) + 1, dtype=bool)
        opens[1:] &= ~inside[:-1]
        closes[1:-1] = inside[:-1] & ~inside[1:]
        if len(data):
            closes[-1] = inside[-1]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # words do not run over into the next text
        joined = edges[inside[edges] & inside[edges - 1]]
        opens[joined] = True
        closes[joined] = True
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes)
        self.data, self.offsets = data, offsets
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of `width` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(BASE) + hashes[k : k + n])
    return out
