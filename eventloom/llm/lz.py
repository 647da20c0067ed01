"""Lempel-Ziv fingerprints: the phrases of a document's dictionary parse, as a bottom-k sketch of their hashes."""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import slices, span_hashes

#: Hashes of a fingerprint.
SIZE = 128
def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


class Parse:
    """The phrases of a text: each is the shortest run of characters that is not a phrase yet. It can go on from a point kept earlier.

    The dictionary is a trie of Python dicts; a phrase that none goes on from is a None in its parent, so that it takes little
    memory. It holds all phrases of the text, however long it is: some 100 bytes for each.
    """

    def __init__(self):
        self.root: dict = {}
        self.node = self.root
        self.ends: list[int] = []
        self.at = 0

    def feed(self, text: str, added: list[tuple[dict, str]] | None = None) -> None:
        """Goes on with more characters. What is added to the dictionary is listed in `added`, so that take_back() can undo it."""
        node, root, absent = self.node, self.root, 0
        note = self.ends.append
        for i, c in enumerate(text, self.at + 1):
            down = node.get(c, absent)
            if down is absent:
                node[c] = None
                if added is not None:
                    added.append((node, c))
                note(i)
                node = root
            elif down is None:
                node[c] = node = {}
            else:
                node = down
        self.node, self.at = node, self.at + len(text)

    def mark(self) -> tuple:
        return self.node, len(self.ends), self.at

    def take_back(self, mark: tuple, added: list[tuple[dict, str]]) -> None:
        for node, c in added:
            node.pop(c, None)
        self.node, n, self.at = mark
        del self.ends[n:]


def hashes(text: str, ends: list[int], begin: int = 0, base: int = 0) -> np.ndarray:
    """The 64-bit hashes of the phrases that end at `ends` (the first begins at `begin`), where text[0] has position `base`."""
    if not ends:
        return np.zeros(0, dtype=np.uint64)
    edges = np.array([begin, *ends], dtype=np.int64) - base
    return span_hashes(points(text), edges[:-1], edges[1:])


def smallest(found: np.ndarray, size: int) -> np.ndarray:
    """The `size` smallest distinct values, ascending."""
    if len(found) > 8 * size:
        few = np.unique(found[found <= np.partition(found, 2 * size)[2 * size]])
        if len(few) >= size:
            return few[:size]
    return np.unique(found)[:size]


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    """The `size` smallest distinct hashes of the text's phrases."""
    parse = Parse()
    parse.feed(text)
    return smallest(hashes(text, parse.ends), size)


def fingerprints(text: str, cut: int, tail: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Those of text and of text[:cut] + tail; what both start with is parsed once."""
    parse, added = Parse(), []
    parse.feed(text[:cut])
    mark = parse.mark()
    n, begin = mark[1], parse.ends[-1] if parse.ends else 0
    parse.feed(text[cut:], added)
    common = smallest(hashes(text[:begin], parse.ends[:n]), size)
    own = hashes(text[begin:], parse.ends[n:], begin, begin)
    parse.take_back(mark, added)
    parse.feed(tail)
    other = hashes(text[begin:cut] + tail, parse.ends[n:], begin, begin)
    return smallest(np.concatenate((common, own)), size), smallest(np.concatenate((common, other)), size)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The estimated share of common phrases (Jaccard), from 0 to 1. Two texts without phrases are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    place = np.arange(2, len(both) + 1) - np.cumsum(twice)  # of each distinct value among all
    return int((twice & (place <= size)).sum()) / int(min(size, place[-1] if len(place) else 1))


def hexed(f: np.ndarray) -> str:
    return f.astype(">u8").tobytes().hex()


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """docs with the column `to`: the fingerprint in hexadecimal, 16 digits a hash. A null or empty text has an empty one.

    Every row stays, repeated rows too; a column of that name is replaced, others may have any name. Equal texts have equal
    fingerprints. Texts of any length are parsed whole, with one dictionary (see Parse). An empty table stays empty.
    """
    docs = docs.drop(to)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{to}` string"])

    def run(batches):
        for batch in slices(batches, text):
            found = [hexed(fingerprint(t or "", size)) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


#: Rows of a range, ranges up to which a range is not larger than that, and rows of a range beyond.
PER_RANGE, FINE, LARGE = 500, 20_000, 20_000


class Ranges:
    """Ranges of rows by descending id (nulls last), then by the text's SHA-256: `number` says which one a row is in.

    Bounds are quantiles of the ids; an id of more rows than a range should hold, or null, has ranges of its own, cut evenly by the
    SHA-256. The driver sees one bound for each range.
    """

    def __init__(self, ids: DataFrame):
        """ids: one column of whole numbers."""
        rows = ids.toDF("id")
        total = rows.count()
        each = max(PER_RANGE, min(-(-total // FINE), LARGE))
        there = rows.where("id is not null")
        known = there.count()
        wanted = max(1, known // each)
        cuts = there.select(F.col("id").cast("double")).approxQuantile("id", [i / wanted for i in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
        hot = there.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * each).collect()  # fewer than ranges
        bounds = {(-c, 0.0) for c in cuts}  # the first place of each range but the first
        for i, n in [*hot, (None, total - known)]:
            at, parts = (math.inf, n // each) if i is None else (-float(i), n // each)
            bounds |= {(at, k / parts) for k in range(parts)} | ({(at, 2.0)} if i is not None else {(at, 0.0)} if n else set())
        self.bounds = sorted(bounds)
        self.hot = {i for i, _ in hot}

    def number(self, i: int | None, share: float) -> int:
        """share: that of the SHA-256 in its range, from 0 to 1; it counts for ids of many rows and for null only."""
        return bisect.bisect_right(self.bounds, (math.inf if i is None else -float(i), share if i is None or i in self.hot else 0.0))


def share(sha: bytes) -> float:
    return int.from_bytes(sha[:6], "big") / (1 << 48)


def neighbours(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """range, guest, id, sha, body: the rows in ranges (see Ranges), and in each range also the first row of the next range.

    In each range, rows by descending id (nulls last; ties by the text's SHA-256), guests last, give each row its successor:
    no range needs another one. Guests of an id that has several rows in a range are all of them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ranges = Ranges(rows.select("id"))

    def numbered(batches):
        for b in batches:
            found = [ranges.number(i, share(bytes.fromhex(h)) if h else 0.0) for i, h in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), b.column(0)], names=["range", "id"])

    spread = F.col("id").isNull() if not ranges.hot else F.col("id").isNull() | F.col("id").isin(*ranges.hot)
    addressed = rows.select("id", F.when(spread, F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12)).alias("sha"))
    tops = addressed.mapInArrow(numbered, "range int, id long").groupBy("range").agg(F.max("id").alias("top")).orderBy("range").collect()
    guests = {(row["range"], row["top"]): tops[k - 1]["range"] for k, row in enumerate(tops)}  # the very first follows the last

    def dealt(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        kinds = {"range": pa.int32(), "guest": pa.bool_(), "id": pa.int64(), "sha": pa.binary(), "body": pa.binary()}
        for batch in slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in kinds}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (t or "").encode()
                sha, body = hashlib.sha256(raw).digest(), pack(raw)
                own = ranges.number(i, share(sha))
                places = [(own, False), *([(guests[own, i], True)] if (own, i) in guests else [])]
                for place, guest in places:
                    for k, x in zip(kinds, (place, guest, i, sha, body), strict=True):
                        out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in kinds.items()], names=list(kinds))

    dealt_rows = rows.mapInArrow(dealt, "range int, guest boolean, id long, sha binary, body binary")
    return dealt_rows.repartition("range").sortWithinPartitions("range", "guest", F.col("id").desc_nulls_last(), "sha")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last third (floor) of the code points gives way to the first as many of the next document, by
    descending id (nulls last; equal ids by the text's SHA-256); after the last comes the first. A single row is its own
    next. Null texts count as empty. Repeated rows stay repeated. Very long texts are parsed whole. An empty table gives no rows.
    """
    kinds = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        last = None  # range and text of the row before
        open_row = None  # the row before that one, which lacks near_next only
        for batch in slices(batches, "body", 1_000_000):
            out: dict[str, list] = {k: [] for k in kinds}

            def close(row, following, out=out):
                for k, x in zip(kinds, (*row[:3], hexed(row[3]), hexed(row[4]), likeness(row[3], row[4], size), likeness(row[3], following, size)), strict=True):
                    out[k].append(x)

            for place, guest, i, _, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guest and (last is None or last[0] != place):
                    continue  # of several guests with one id, the first counts
                t = unpack(body).decode()
                if last is not None and last[0] == place:
                    _, own, mine = last
                    cut = len(mine) - len(mine) // 3
                    tail = t[: len(mine) - cut]
                    whole, edited = fingerprints(mine, cut, tail, size)
                    if open_row is not None:
                        close(open_row, whole)
                    open_row = (own, len(mine), hashlib.sha256((mine[:cut] + tail).encode()).hexdigest(), whole, edited)
                if guest:
                    close(open_row, fingerprint(t, size))
                    last = open_row = None
                else:
                    last = (place, i, t)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in kinds.items()], names=list(kinds))

    found = neighbours(docs, id_col, text).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("id", id_col)
