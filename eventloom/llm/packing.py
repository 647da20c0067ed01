"""Best-fit packing of token sequences by patterns of few lengths, whose repeats are fitted to the histogram of lengths."""

from __future__ import annotations

import bisect
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.bpe import crc, encode_batches
from eventloom.llm.common import stored

#: How many of the most frequent lengths stand in patterns of three, rounds of the fit, and columns that it adds in a round.
PIVOTS, ROUNDS, ROUND = 6, 60, 48
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut only if they are more than the capacity.

    Then all pieces but the first have the full length. A null or empty text is one piece of end_id alone.
    """
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        end = np.array([end_id], dtype="<u4")
        for batch, _, found in encode_batches(batches, path, text):
            out: list[list] = [[] for _ in names]
            for i, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = np.concatenate((ids, end))
                edges = [0, *range(len(ids) % capacity or min(len(ids), capacity), len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, x in zip(out, (i, k, a, b - a, crc(ids[a:b])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias(text)).mapInArrow(run, PIECES)


def candidates(counts: np.ndarray, capacity: int, pivots: int = PIVOTS) -> np.ndarray:
    """Patterns that fill a sequence: all pairs of lengths, and all triples in which one of the `pivots` most frequent lengths takes part (0: none)."""
    there = np.flatnonzero(counts)
    there = there[there < capacity]
    have = counts > 0
    frequent = there[np.argsort(-counts[there], kind="stable")[:pivots]]
    found = [np.stack((there, capacity - there, np.zeros_like(there)), 1)]
    for p in frequent.tolist():
        rest = capacity - p - there
        keep = (rest > 0) & have[np.clip(rest, 0, capacity)]
        found.append(np.stack((there[keep], rest[keep], np.full(keep.sum(), p)), 1))
    rows = np.sort(np.concatenate(found), axis=1)
    rows = rows[have[rows[:, 1]] & have[rows[:, 2]] & (rows[:, 1] > 0)]
    return np.unique(rows, axis=0)


def fit(counts: np.ndarray, patterns: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats x >= 0 of the patterns with the least squares of (lengths used - counts), by an active set."""
    n, size = len(patterns), len(counts)
    x = np.zeros(n)
    if not n:
        return x
    active = np.zeros(0, dtype=np.int64)
    scale = max(1.0, float(counts.max()))
    target = counts / scale

    def used(cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(patterns[cols].ravel(), np.repeat(weights, 3), minlength=size)

    def matrix(cols: np.ndarray) -> np.ndarray:
        m = np.zeros((size, len(cols)))
        for k in range(3):
            np.add.at(m, (patterns[cols, k], np.arange(len(cols))), 1.0)
        m[0] = 0
        return m

    for _ in range(rounds):
        short = target - used(active, x[active])
        short[0] = 0
        gain = short[patterns].sum(axis=1)
        gain[active] = -np.inf
        new = np.argsort(-gain, kind="stable")[: min(ROUND, size)]
        new = new[gain[new] > 1e-9]
        if not len(new):
            break
        active = np.union1d(active, new)
        for _ in range(50):  # solve, and step back from what would turn negative
            m = matrix(active)
            s = np.linalg.solve(m.T @ m + 1e-9 * np.eye(len(active)), m.T @ target)
            if (s >= 0).all():
                x[active] = s
                break
            old = x[active]
            useless = (s < 0) & (old <= 1e-12)
            if useless.any():
                x[active[useless]] = 0
                active = active[~useless]
            else:
                step = (old[s < 0] / (old[s < 0] - s[s < 0])).min()
                moved = old + step * (s - old)
                x[active] = np.where(moved > 1e-12, moved, 0)
                active = active[moved > 1e-12]
            if not len(active):
                break
    return x * scale


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over a histogram: equal sequences are one class with a count."""
    spaces: list[int] = []  # sorted spaces of open classes
    open_at: dict[int, dict[tuple[int, ...], int]] = {}

    def put(space: int, pattern: tuple[int, ...], k: int) -> None:
        if space not in open_at:
            open_at[space] = {}
            bisect.insort(spaces, space)
        open_at[space][pattern] = open_at[space].get(pattern, 0) + k

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                    left %= each
                if left:
                    put(capacity - left * length, (length,) * left, 1)
                break
            space = spaces[at]
            pattern, k = open_at[space].popitem()
            if not open_at[space]:
                del open_at[space]
                spaces.pop(at)
            each = min(space // length, -(-left // k))  # what each of the class takes
            whole = min(k, left // each)
            if whole < k:
                put(space, pattern, k - whole)
            if whole:
                put(space - each * length, (*pattern, *(length,) * each), whole)
            left -= whole * each
            if not whole:
                each = left
                put(space, pattern, -1)
                if not open_at[space][pattern]:
                    del open_at[space][pattern]
                    if not open_at[space]:
                        del open_at[space]
                        spaces.remove(space)
                put(space - each * length, (*pattern, *(length,) * each), 1)
                left = 0
    return [(p, k) for group in open_at.values() for p, k in group.items()]


def plan(counts: np.ndarray, capacity: int, pivots: int = PIVOTS, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their repeats; together they use each length as often as it is there. What no pattern takes, best fit packs."""
    left, found = counts.astype(np.int64).copy(), []
    left[0] = 0
    if left[capacity]:
        found.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = candidates(left, capacity, pivots)
    x = fit(left.astype(float), patterns, rounds)
    for i in np.argsort(-x, kind="stable").tolist():
        pattern = tuple(v for v in patterns[i].tolist() if v)
        k = min(int(x[i]), *(int(left[v]) // pattern.count(v) for v in pattern))
        if k > 0:
            found.append((pattern, k))
            for v in pattern:
                left[v] -= k
    return found + best_fit(left, capacity)


def slots(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: from which rank on, the sequence of that rank, and the place in it. Ranks that follow take the next sequences."""
    taken, table, sequence = np.zeros(capacity + 1, dtype=np.int64), {}, 0
    for pattern, k in planned:
        place = 0
        for v in pattern:
            table.setdefault(v, []).append((int(taken[v]), sequence, place))
            taken[v] += k
            place += v
        sequence += k
    return {v: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for v, rows in table.items()}


def pack(found: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32"), pivots: int = PIVOTS, rounds: int = ROUNDS) -> DataFrame:
    """found with sequence_id and offset: rows of `length` (1 to capacity) in as few sequences of that capacity as it can.

    The driver sees how often each length is there, at most `capacity` numbers, and plans patterns; each row takes the slot
    of its rank among its length. Ranks are counted in salted groups, so that no length is in one task. Rows that are equal
    in `order` may swap their slots. pivots, rounds: more make patterns of three of more lengths, or a closer fit, for more of the
    driver's time; all rows are packed whatever they are. An empty table gives no rows.
    """
    rows = stored(found.drop("sequence_id", "offset"))
    names = rows.columns
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in rows.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row[0]] = row[1]
    salts = max(isqrt(int(counts.sum())), 16)  # as many groups of a length as rows in a group
    table = slots(plan(counts, capacity, pivots, rounds), capacity)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(length, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(length).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(length, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(length, "__salt").orderBy(*order)).cast("long")).join(bases, [length, "__salt"])
    ranked = ranked.select(*rows.columns, (F.col("__base") + F.col("__rank") - 1).alias("__rank"))

    def run(batches):
        for batch in batches:
            size, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in (length, "__rank"))
            sequence, place = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for v in np.unique(size).tolist():
                mine = np.flatnonzero(size == v)
                start, first, at = table[v]
                k = np.searchsorted(start, rank[mine], side="right") - 1
                sequence[mine], place[mine] = first[k] + rank[mine] - start[k], at[k]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(sequence), pa.array(place)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of docs (see pieces) with the sequence and the place in it that each takes.

    Null ids and repeated rows are packed like any other; very long texts are cut into pieces, none is dropped; an empty table gives
    no rows; columns of docs may have any name.
    """
    return pack(pieces(docs, path, capacity, end_id, id_col, text), capacity)
