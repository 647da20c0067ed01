"""Near copies: all pairs of documents whose word shingles have a Jaccard similarity of 3/4 or more, and their components.

Candidates share one of each document's rarest shingles (its prefix: two similar sets always do). They meet in buckets, where
an R-tree over count vectors bounds their overlap; what survives is verified on whole sets. Links that components already
imply are not looked for, so that a large group of near copies is not expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cleared, forget, mix, salted, shared_dir, shingles, stored, stored_at, unused, without
from eventloom.llm.components import components, merged
from eventloom.llm.grams import batches_of, joined_counts, pack, pack_sorted, unpack, unpack_sorted

#: Words of a shingle, and the least similarity as a share of 100.
WIDTH, LEAST = 5, 75
#: Bytes of a shingle's hash in the table of counts: it only orders shingles, so that equal cuts do no harm.
KEY_WIDTH = 5
#: Coordinates of a count vector, points of a leaf, leaves of a branch, and rows of a bucket that one task compares with as many.
GROUPS, LEAF, BRANCH, CHUNK = 512, 16, 8, 1500
#: Rounds in which each document is verified with its most promising partner only, before all that are left.
SINGLE_ROUNDS = 1


def similar(overlap, a, b):
    """Whether sets of sizes a and b with such an overlap (or a bound of it) are similar enough."""
    return 100 * overlap >= LEAST * (a + b - overlap)


class Sets:
    """The shingle sets of a batch: `hashes` in ascending order within each document, `doc` of each, `sizes`, and `ids` and `checks` of the sets."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray):
        n_docs, lengths = len(firsts) - 1, np.diff(firsts)
        found = shingles(words, WIDTH)
        ends = np.repeat(firsts[1:], lengths)
        at = np.flatnonzero(np.arange(len(found)) + WIDTH <= ends[: len(found)])
        short = np.flatnonzero((lengths > 0) & (lengths < WIDTH)).tolist()
        whole = np.array([shingles(words[firsts[k] : firsts[k + 1]], int(lengths[k]))[0] for k in short], dtype=np.uint64)
        doc = np.concatenate((np.repeat(np.arange(n_docs), lengths)[at], np.array(short, dtype=np.int64)))
        hashes = np.concatenate((found[at], whole))
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        self.doc, self.hashes = doc[new], hashes[new]
        self.sizes = np.bincount(self.doc, minlength=n_docs)
        self.firsts = np.concatenate(([0], np.cumsum(self.sizes)))
        full = self.sizes > 0
        self.ids, self.checks = (self.summed(mix(self.hashes ^ np.uint64(seed)), full, seed) for seed in (0, 0xA0761D6478BD642F))

    def summed(self, mixed: np.ndarray, full: np.ndarray, seed: int) -> np.ndarray:
        """A hash of each set, from the sum of its shingles' and its size."""
        sums = np.zeros(len(self.sizes), dtype=np.uint64)
        if len(self.doc):
            sums[full] = np.add.reduceat(mixed, self.firsts[:-1][full])
        return mix(sums + mix(self.sizes.astype(np.uint64) ^ np.uint64(seed))).view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str, text: str, path: str) -> DataFrame:
    """id, n, cid, check, and, where the set may have a partner, tokens, weight, counts and shingles.

    path: where batches of docs are kept until this is read. cid and check: two hashes of the set (null: empty). tokens: those of its prefix, the 1/4 rarest shingles and one
    more, that another set holds. weight: how often its shingles come, on average. counts: its count vector.
    """

    def keys_of(words, firsts):
        sets = Sets(words, firsts)
        _, one = np.unique(sets.ids, return_index=True)  # copies within the batch count once
        keep = np.zeros(len(sets.sizes), dtype=bool)
        keep[one] = True
        keys, adds = np.unique(sets.hashes[keep[sets.doc]] >> np.uint64(64 - 8 * KEY_WIDTH), return_counts=True)
        return keys, adds, sets

    def finish(ids, sets, keys, totals):
        often = totals[np.searchsorted(keys, sets.hashes >> np.uint64(64 - 8 * KEY_WIDTH))] if len(sets.hashes) else np.zeros(0, dtype=np.int64)
        prefix = sets.sizes + (-LEAST * sets.sizes // 100) + 1  # size - ceil(3/4 size) + 1
        single = np.bincount(sets.doc[often < 2], minlength=len(sets.sizes))
        out: dict[str, list] = {"tokens": [], "weight": [], "counts": [], "shingles": []}
        for k in range(len(sets.sizes)):
            row: tuple = (None,) * 4
            if sets.sizes[k] and single[k] < prefix[k]:
                a, b = sets.firsts[k], sets.firsts[k + 1]
                mine, times = sets.hashes[a:b], often[a:b]
                order = np.lexsort((mine, times))[: prefix[k]]
                row = (
                    mine[order][times[order] > 1].view(np.int64).tolist(),
                    float(times.mean()),
                    pack(np.bincount((mine >> np.uint64(9)).astype(np.int64) % GROUPS, minlength=GROUPS), 4),
                    pack_sorted(mine, 8),
                )
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)
        kinds = (pa.list_(pa.int64()), pa.float64(), pa.binary(), pa.binary())
        columns = {c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)}
        return pa.table({"id": ids, "n": pa.array(sets.sizes.astype(np.int64)), "cid": pa.array(sets.ids, mask=sets.sizes == 0), "check": pa.array(sets.checks, mask=sets.sizes == 0), **columns})

    return joined_counts(batches_of(docs, id_col, text, path), keys_of, finish, "id long, n long, cid long, check long, tokens array<long>, weight double, counts binary, shingles binary", KEY_WIDTH)


def told_apart(found: DataFrame) -> DataFrame:
    """found (which is stored) without check; sets whose cid is that of another set, which their check tells, get a cid of their own."""
    names = [c for c in found.columns if c != "check"]
    first = found.where("cid is not null").groupBy("cid").agg(F.min("check").alias("first"), F.max("check").alias("last")).where("first != last").select("cid", "first")
    if first.isEmpty():  # as good as always: then no row need be sent anywhere
        return found.select(*names)
    other = F.when(F.col("check") != F.col("first"), F.xxhash64("cid", "check")).otherwise(F.col("cid"))
    return salted(found, first, "cid", ["id"]).withColumn("cid", other).select(*names)


class Tree:
    """A bulk-loaded R-tree of two levels over count vectors: boxes are the greatest counts, and the sizes, of what they hold."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = self.split(points, np.arange(len(points)))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.leaves, self.leaf_sizes = self.boxes(self.points, self.sizes, LEAF)
        self.branches, self.branch_sizes = self.boxes(self.leaves, self.leaf_sizes, BRANCH)

    def split(self, points: np.ndarray, which: np.ndarray) -> np.ndarray:
        """An order in which neighbours are near: halved at the median of the coordinate that differs most."""
        if len(which) <= LEAF:
            return which
        own = points[which]
        which = which[np.argsort(own[:, int(np.argmax(own.var(axis=0)))], kind="stable")]
        half = LEAF * max(1, len(which) // (2 * LEAF))
        return np.concatenate((self.split(points, which[:half]), self.split(points, which[half:])))

    @staticmethod
    def boxes(points: np.ndarray, sizes: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, len(points), each)
        return np.maximum.reduceat(points, starts, axis=0), np.minimum.reduceat(sizes, starts)

    def search(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that may be similar to this one, and the bounds of their overlap: the sum of the lesser counts."""
        found = np.flatnonzero(similar(self.bound(self.branches, point), size, self.branch_sizes))
        for boxes, sizes, each in ((self.leaves, self.leaf_sizes, BRANCH), (self.points, self.sizes, LEAF)):
            below = (found[:, None] * each + np.arange(each)).ravel()
            below = below[below < len(boxes)]
            bounds = self.bound(boxes[below], point)
            keep = similar(np.minimum(bounds, np.minimum(size, sizes[below]) if boxes is self.points else bounds), size, sizes[below])
            found, kept = below[keep], bounds[keep]
        return self.order[found], kept

    @staticmethod
    def bound(boxes: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.minimum(boxes, point).sum(axis=1, dtype=np.int64)


def dealt(bucketed: DataFrame) -> DataFrame:
    """bucket, kind, i, j, side, cid, label: the groups in which the sets of open buckets are compared, of about 2 * CHUNK rows at most.

    bucketed: bucket, cid, label. A bucket is open if it has more than one label. One of up to CHUNK sets is a group (kind 0). In
    a larger one, sets of its most frequent label need not be compared with each other: all others (strays) are cut into
    chunks, and each chunk meets each chunk of that label (1: strays on side 0, the others on side 1) and each of strays (2: side is the chunk).
    """
    sizes = bucketed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most")).where("size > most.n")
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    rows = bucketed.join(sizes, "bucket").withColumns({"strays": chunks(F.col("size") - F.col("most.n")), "rest": chunks(F.col("most.n")), "stray": F.col("label") != F.col("most.label")})
    rows = rows.withColumn("own", F.pmod(F.hash("cid"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("rest"))))
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    zero, one, own = F.lit(0), F.lit(1), F.col("own")
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    places = (
        F.when(F.col("size") <= CHUNK, F.array(place(0, zero, zero, zero)))
        .when(F.col("stray"), F.concat(F.transform(upto("rest"), lambda k: place(1, own, k, zero)), F.transform(upto("strays"), lambda k: place(2, F.least(own, k), F.greatest(own, k), own))))
        .otherwise(F.transform(upto("strays"), lambda k: place(1, k, own, one)))
    )
    return rows.select("bucket", F.explode(places).alias("at"), "cid", "label").select("bucket", "at.*", "cid", "label")


def candidates(bucketed: DataFrame, sets: DataFrame, single: bool) -> DataFrame:
    """a, b: pairs of sets of one bucket that are in different components and whose bound allows a link (see dealt).

    single: of each set that is looked up, only the partner with the largest bound against its sizes.
    """
    rows = dealt(bucketed).join(sets.select("cid", "n", "counts"), "cid")

    def search(table: pa.Table) -> pa.Table:
        cid, label, size, side = (table.column(c).to_numpy() for c in ("cid", "label", "n", "side"))
        kind, i, j = (table.column(c)[0].as_py() for c in ("kind", "i", "j"))
        points = np.stack([unpack(b, 4) for b in table.column("counts").to_pylist()])
        points = points.astype(np.int32 if points.max() > 30_000 else np.int16)
        left, right = (np.flatnonzero(side == k) for k in ((0, 1) if kind == 1 else (i, j)))
        within = kind != 1 and i == j  # both sides are the same sets: each pair comes twice
        out_a, out_b = [], []
        if len(left) and len(right):
            tree = Tree(points[right], size[right])
            for k in left.tolist():
                found, bounds = tree.search(points[k], int(size[k]))
                found = right[found]
                keep = (label[found] != label[k]) & ((cid[found] > cid[k]) | (not within) | single)
                found, bounds = found[keep], bounds[keep]
                if single and len(found):
                    found = found[[int(np.argmax(bounds / (size[found] + size[k])))]]
                out_a += np.minimum(cid[found], cid[k]).tolist()
                out_b += np.maximum(cid[found], cid[k]).tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows.groupBy("bucket", "kind", "i", "j").applyInArrow(search, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    rows = pairs.select("a", "b").join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(batch.schema.get_field_index("x")).to_pylist(), batch.column(batch.schema.get_field_index("y")).to_pylist(), strict=True):
                p, q = unpack_sorted(x, 8), unpack_sorted(y, 8)
                both = np.sort(np.concatenate((p, q)))
                keep.append(bool(similar(int((both[1:] == both[:-1]).sum()), len(p), len(q))))
            keep = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def links(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal sets that connect all classes with a similar partner, and their components (node, label)."""
    sets = stored(found.where("tokens is not null").groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "tokens", "weight", "counts", "shingles")]))
    tokens = sets.select("cid", "weight", F.explode("tokens").alias("token"))
    # the bucket of a token is named after the set in it whose shingles come most often, likely what its copies were made from
    heads = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("weight", "cid")).alias("head")).where("size > 1")
    shared = stored(tokens.join(heads, "token").groupBy(F.col("head.cid").alias("bucket"), "cid").agg(F.count(F.lit(1)).alias("times")))
    first = shared.where("bucket != cid").groupBy("cid").agg(F.max(F.struct("times", "bucket")).alias("best")).select(F.col("cid").alias("a"), F.col("best.bucket").alias("b"))
    known = stored(verified(first, sets))
    labels = stored(components(known))
    rounds = [True] * SINGLE_ROUNDS + [False]
    while rounds:
        single = rounds.pop(0)
        bucketed = shared.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", F.coalesce("label", "cid").alias("label"))
        new = stored(verified(candidates(bucketed, sets, single), sets))
        if new.isEmpty():
            rounds = rounds[-1:] if single else []  # only all pairs that are left can bring more
            continue
        known = known.union(new)
        labels = stored(merged(labels, new))
    return known, labels


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id that links lead to, itself included.

    Words are runs of other than ASCII white space, A-Z as a-z. A document's set: its distinct shingles of WIDTH words; with
    fewer words, the whole sequence as one. Two documents link if the intersection has LEAST hundredths of the union or
    more. Null, empty and blank texts have no set and link with nothing. Rows with a null id link others, but name no
    component: one of such rows alone has a null id. Repeated rows are copies. Very long texts are taken whole, as one batch
    each. An empty table gives no rows.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    found = told_apart(stored(shingle_sets(docs, id_col, text, path)))
    forget(spark, path)
    _, labels = links(found)
    # copies of one text may be a third of all rows, and so may a component
    rows = salted(found.select("id", "n", "cid"), labels.withColumnRenamed("node", "cid"), "cid", ["id"]).select("id", "n", F.coalesce("label", "cid").alias("label"))
    least = rows.where("label is not null").groupBy("label").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1").select("label", "least")
    return salted(rows, least, "label", ["id"]).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of near copies: that of the smallest id; of several, any one; nulls come last.

    So repeated rows and rows with a null id that copy another one go too, and of two texts under one id each is judged by
    itself. Null, empty and blank texts copy nothing and stay. Rows are numbered and written to the shared folder first. Columns may have
    any name; very long texts are taken whole; an empty table stays empty.
    """
    row = unused(docs, "row")
    spark = docs.sparkSession
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    with cleared(spark) as keep:  # of the search for copies only its result is needed
        keep.append(shared_dir(spark))
        found = stored_at(near_copies(numbered, row, text), keep[0]).select(F.col(row).alias("row"), "component_id")
    ids = numbered.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"))
    sizes = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1")  # a row alone stays
    grouped = salted(found, sizes, "component_id", ["row"]).where("size is not null").drop("size")
    members = grouped.join(ids, "row")
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")).select("least.row")
    return without(numbered, grouped.select("row").join(stays, "row", "left_anti"), row, text).drop(row)
