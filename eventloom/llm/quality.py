"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network with calibrated probabilities."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import slices, span_hashes, unused

#: Words have 2^BITS rows by hash. Vectors have DIM numbers; a word's index vector has TAPS of +1 or -1; REACH words on each side are context.
BITS, DIM, TAPS, REACH = 18, 32, 2, 2
#: Rows of vectors that are summed up, and sent, together.
CHUNK = 1 << 10
#: The classifier is fitted on so many labelled documents at most: those with the smallest hashes of their ids.
MOST_ROWS = 20_000
HIDDEN, ROUNDS, SEED = 24, 400, 7
#: A document is kept if its probability of label 1 is at least this.
LEAST = 0.3

#: Of each byte: 0 white space, 1 letters and what is not ASCII, 2 digits, 3 the rest. A run of one class is a word.
CLASSES = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], dtype=np.uint8)


def words(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word of the texts, and the first word of each text and after the last."""
    arr = texts.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + arr.offset + 1)[arr.offset :]
    data = np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = CLASSES[data]
    change = np.ones(len(data) + 1, dtype=bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True  # words end with their text
    edges = np.flatnonzero(change)
    real = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][real], edges[1:][real]
    return (span_hashes(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(starts, offsets)


@functools.cache
def index_vectors(bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the taps of each row's index vector; fixed by SEED, so that every task knows them."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (1 << bits, TAPS), dtype=np.int16), rng.integers(0, 2, (1 << bits, TAPS), dtype=np.int16).astype(np.float32) * 2 - 1


def context_sums(batches: Iterable[pa.RecordBatch], text: str, bits: int = BITS) -> np.ndarray:
    """Of each row: the sum of the index vectors of its words' contexts, and in the last column how often it comes."""
    places, signs = index_vectors(bits)
    sums = np.zeros((1 << bits, DIM + 1), dtype=np.float32)  # whole numbers, exact up to 2^24 in a task
    for batch in slices(batches, text, 400_000):
        rows, first = words(batch.column(0), bits)
        used, own = np.unique(rows, return_inverse=True)
        flat = np.zeros(len(used) * DIM)
        ends = np.repeat(first[1:], np.diff(first))
        for reach in range(1, REACH + 1):
            near = np.flatnonzero(np.arange(reach, len(rows) + reach) < ends)
            for word, context in ((near, near + reach), (near + reach, near)):
                for k in range(TAPS):
                    flat += np.bincount(own[word] * DIM + places[rows[context], k], signs[rows[context], k], minlength=len(flat))
        sums[used, :DIM] += flat.reshape(-1, DIM).astype(np.float32)
        sums[used, DIM] += np.bincount(own, minlength=len(used)).astype(np.float32)
    return sums


def learn_vectors(docs: DataFrame, text: str, bits: int = BITS) -> np.ndarray:
    """Word vectors from all of docs: each task sums the contexts of its words, sums are added up by chunks of rows.

    Of a task's sums only rows that it has used are sent. What comes to the driver is 2^bits rows of DIM + 1 numbers at most,
    whatever the input.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums = context_sums(batches, text, bits)
        used = np.flatnonzero(sums[:, DIM])
        firsts = np.searchsorted(used, np.arange(0, (1 << bits) + 1, CHUNK)) if len(used) else np.zeros(1, dtype=np.int64)
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in np.flatnonzero(np.diff(firsts)).tolist():
            own = used[firsts[k] : firsts[k + 1]]
            raw = pack((own % CHUNK).astype("<u2").tobytes() + sums[own].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([raw], pa.binary())], names=["chunk", "n", "sums"])

    def unpack(n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        return np.frombuffer(raw, dtype="<u2", count=n), np.frombuffer(raw, dtype=np.float32, offset=2 * n).reshape(n, DIM + 1)

    def add(batches) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, found = unpack(n, raw)
                total.setdefault(k, np.zeros((CHUNK, DIM + 1)))[at] += found
        for k, sums in total.items():
            at = np.flatnonzero(sums[:, DIM])
            raw = zstandard.ZstdCompressor(level=1).compress(at.astype("<u2").tobytes() + sums[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([raw], pa.binary())], names=["chunk", "n", "sums"])

    schema = "chunk int, n int, sums binary"
    parts = docs.select(F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
    sums = np.zeros((1 << bits, DIM + 1), dtype=np.float32)
    for k, n, raw in parts.repartition("chunk").mapInArrow(add, schema).toLocalIterator():
        at, found = unpack(n, bytes(raw))
        sums[k * CHUNK + at.astype(np.int64)] = found
    return sums


@dataclass
class Vectors:
    """Vectors of length 1, and weights of rare words, of the rows whose words the corpus has; a last one stands for all other rows."""

    bits: int
    rows: np.ndarray
    unit: np.ndarray
    rare: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray) -> Vectors:
        used = np.flatnonzero(sums[:, DIM])
        counts = np.append(sums[used, DIM], 0)
        own = np.concatenate((sums[used, :DIM], np.zeros((1, DIM), dtype=np.float32)))
        length = np.linalg.norm(own, axis=1, keepdims=True)
        share = counts / max(1.0, float(counts.sum(dtype=np.float64)))
        return cls(len(sums).bit_length() - 1, used.astype(np.int32), (own / np.maximum(length, 1e-9)).astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32))

    def pools(self, texts: pa.Array) -> np.ndarray:
        """Of each text: the means of its words' vectors, plain and with rare words in front, that of the index vectors, and sizes."""
        rows, first = words(texts, self.bits)
        places, signs = index_vectors(self.bits)
        known = np.minimum(np.searchsorted(self.rows, rows), max(0, len(self.rows) - 1))
        known = np.where(self.rows[known] == rows, known, len(self.rows)) if len(self.rows) else np.zeros(len(rows), dtype=np.int64)
        sizes = np.diff(first)
        out = np.zeros((len(sizes), 3 * DIM + 3))
        full = np.flatnonzero(sizes)
        if len(full):
            at, own = first[:-1][full], self.unit[known]
            out[full, :DIM] = np.add.reduceat(own, at, axis=0) / sizes[full, None]
            out[full, DIM : 2 * DIM] = np.add.reduceat(own * self.rare[known, None], at, axis=0) / sizes[full, None]
            text = np.repeat(np.arange(len(sizes)), sizes) * DIM
            flat = sum(np.bincount(text + places[rows, k], signs[rows, k], minlength=len(sizes) * DIM) for k in range(TAPS))
            out[full, 2 * DIM : 3 * DIM] = flat.reshape(-1, DIM)[full] / sizes[full, None]
        out[:, -3] = np.linalg.norm(out[:, :DIM], axis=1)
        out[:, -2] = np.linalg.norm(out[:, 2 * DIM : 3 * DIM], axis=1)
        out[:, -1] = np.log1p(sizes)
        return out


@dataclass
class Model:
    """Word vectors (sent to all tasks once), and a network of standardised pools, hidden tanh units and one output, divided by a temperature."""

    vectors: Broadcast[Vectors]
    center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    prior: float = 0.5

    def pools(self, texts: pa.Array) -> np.ndarray:
        return self.vectors.value.pools(texts)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pools(texts)) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        """Fits the network by Adam on four fifths of the rows and the temperature on the rest."""
        if len(np.unique(y)) < 2:
            self.prior = float(y[0]) if len(y) else 0.5
            return self
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.center, self.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
        z, t = (x[own] - self.center) / self.scale, y[own]
        params = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        slow, fast = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(max(3, ROUNDS * 2_000 // max(2_000, len(z)))):
            for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                a, b = z[part], t[part]
                h = np.tanh(a @ params[0] + params[1])
                e = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - b) / len(part)
                back = np.outer(e, params[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ e + 1e-4 * params[2], e.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    slow[k] = 0.9 * slow[k] + 0.1 * g
                    fast[k] = 0.999 * fast[k] + 0.001 * g * g
                    params[k] -= 0.003 * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.999**step)) + 1e-8)
        self.layers = params
        if len(held):
            logits = self.logits(x[held])

            def loss(temperature: float) -> float:
                return float(np.mean(np.logaddexp(0, -(2 * y[held] - 1) * logits / temperature)))

            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", bits: int = BITS, most: int = MOST_ROWS) -> Model:
    """A model with word vectors from all of docs and a network from at most `most` labelled documents.

    labels: id and label (0 or 1; null: none; of several of one id, the mean, rounded). Of several texts of one id, the one with
    the least pools counts. Without labelled documents, or with one class only, every score is that class, or 0.5.
    bits: words have 2^bits rows of vectors by hash.
    """
    model = Model(docs.sparkSession.sparkContext.broadcast(Vectors.of(learn_vectors(docs, text, bits))))
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.round(F.avg(label)).cast("double").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 400_000):
            pools = model.pools(batch.column(2)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in pools], pa.binary())], names=["id", "label", "pools"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")
    found = rows.mapInArrow(run, "id long, label double, pools binary").groupBy("id").agg(F.first("label").alias("label"), F.min("pools").alias("pools")).collect()  # one row a chosen document
    if not found:
        return model
    found.sort(key=lambda r: r["id"])
    return model.fit(np.stack([np.frombuffer(r["pools"], dtype=np.float32) for r in found]).astype(np.float64), np.array([r["label"] for r in found]))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the column `to`: the probability of label 1. Null and empty texts get one too; a column of that name is replaced."""
    docs = docs.drop(to)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{to}` double"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 400_000):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(names.index(text))))], names=[*names, to])

    return docs.mapInArrow(run, schema)


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """Per row: id, held_out (crc32 of the id as text, modulo 5, is 0), score and predicted. Held-out rows' labels are never learnt from.

    Null, empty and blank texts have no words and get the score of such a text; null ids are not held out; very long texts are
    taken whole; equal texts, and repeated rows, have equal scores; an empty table gives no rows.
    """
    model = train(docs, labels.where(~is_held_out(id_col)), id_col, text, bits=bits)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text)).withColumn("held_out", is_held_out(id_col))
    return score(rows, model, text).select(id_col, "held_out", "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose score is at least LEAST, repeated rows too. The model, and odd rows, are as in classify(); columns may have any name."""
    model = train(docs, labels.where(~is_held_out(id_col)), id_col, text)
    to = unused(docs, "score")
    return score(docs, model, text, to).where(F.col(to) >= LEAST).select(*docs.columns)
