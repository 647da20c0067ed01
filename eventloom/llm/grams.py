"""Counts of word n-grams over a whole corpus: tables partitioned by hash, filled from batches of documents and joined back to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Words, slices, stored, stored_at

#: Bytes of text in a batch of documents, unless a single one is larger.
BATCH = 4_000_000
#: Spark's switch that deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pack(x: np.ndarray, width: int) -> bytes:
    """Integers of `width` bytes, compressed byte by byte of all, as their high bytes are alike."""
    raw = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray, width: int) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)), width)


def unpack_sorted(raw: bytes, width: int) -> np.ndarray:
    return np.cumsum(unpack(raw, width), dtype=np.uint64)


def batches_of(docs: DataFrame, id_col: str, text: str, path: str, level: int = 1) -> DataFrame:
    """batch, n_docs, body: the ids and texts (null: empty) of docs in batches, written to a path in the shared folder.

    level: that of compression; Arrow's own is 1.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal count, held
            count += 1
            table = pa.table({"id": pa.concat_arrays(ids), "text": pa.concat_arrays(texts)})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
                out.write_table(table)
            body = sink.getvalue().to_pybytes()
            ids.clear()
            texts.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | count], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([body], pa.binary())], names=["batch", "n_docs", "body"])

        for batch in slices(batches, text, BATCH):
            size = batch.column(1).nbytes
            if ids and held + size > BATCH:
                yield close()
            ids.append(batch.column(0))
            texts.append(batch.column(1).fill_null(""))
            held += size
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias(text))
    return stored_at(rows.mapInArrow(run, "batch long, n_docs long, body binary"), path)


def stored_alone(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; the shuffle files that led to it go before anything else is written."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return stored(df)
    finally:
        spark.conf.set(CLEANUP, before)


def opened(body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, word hashes (A-Z as a-z) and the first word of each document and after the last, of a batch's body."""
    with pa.ipc.open_stream(body) as reader:
        table = reader.read_all().combine_chunks()
    hashes, firsts, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], 0
    for part in slices(table.select(["text"]).to_batches(), "text", 400_000):
        found = Words(part.column(0))
        hashes.append(found.hashes)
        firsts.append(found.first[1:] + at)
        at += len(found.hashes)
    ids = table.column("id")
    return (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids), np.concatenate(hashes), np.concatenate(firsts)


def joined_counts(batches: DataFrame, keys_of: Callable, finish: Callable, schema: str, width: int = 8, alone: bool = False) -> DataFrame:
    """finish(ids, state, keys, totals) of each batch, where totals are the keys' sums over all batches.

    keys_of(words, firsts) gives a batch's distinct keys (unsigned integers below 2^(8 * width), ascending), what each
    adds to its sum, and any state for finish. A batch sends each part of the count table one block of keys; the part adds up the blocks and
    sends the sums back. So an n-gram in very many documents is one key a batch, and parts are even by their hash.
    There are as many parts as batches, or up to twice as many, so that a part stays as large at any size of the corpus; blocks
    that would hold no key are not sent, so that there are never more of them than exploded n-grams.
    alone: the sums are stored, and the blocks' shuffle files deleted, before the bodies are shuffled, which are as large.
    """
    wanted = batches.count()
    bits = max(4, (max(wanted, 1) - 1).bit_length())
    shift = np.uint64(8 * width - bits)

    def send(rows) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, body in zip(row.column(0).to_pylist(), row.column(1).to_pylist(), strict=True):
                _, words, firsts = opened(body)
                keys, adds, _ = keys_of(words, firsts)
                full, starts = np.unique(keys >> shift, return_index=True)
                full, edges = full.tolist(), [*starts.tolist(), len(keys)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([batch] * len(full), pa.int64()),
                        pa.array([pack_sorted(keys[a:b], width) for a, b in pairwise(edges)], pa.binary()),
                        pa.array([pack(adds[a:b], 4) for a, b in pairwise(edges)], pa.binary()),
                    ],
                    names=["part", "batch", "keys", "adds"],
                )

    def add(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(b, width) for b in table.column("keys").to_pylist()]
        adds = [unpack(b, 4) for b in table.column("adds").to_pylist()]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, np.concatenate(adds)).astype(np.int64)[place]
        edges = np.cumsum([0, *[len(k) for k in keys]])
        sums = [pack(totals[a:b], 5) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "sums": pa.array(sums, pa.binary())})

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        sums = right.column("sums").to_pylist()
        totals = np.concatenate([unpack(b, 5) for b in sums]).astype(np.int64) if sums else np.zeros(0, dtype=np.int64)
        ids, words, firsts = opened(left.column("body")[0].as_py())
        keys, _, state = keys_of(words, firsts)
        return finish(ids, state, keys, totals)

    blocks = batches.select("batch", "body").mapInArrow(send, "part int, batch long, keys binary, adds binary")
    sums = blocks.groupBy("part").applyInArrow(add, "batch long, part int, sums binary")
    sums = stored_alone(sums) if alone else sums
    return batches.select("batch", "body").groupBy("batch").cogroup(sums.groupBy("batch")).applyInArrow(close, schema)
