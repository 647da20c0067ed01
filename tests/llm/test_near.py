import collections
import random
import re

import numpy as np
import pytest

from eventloom.llm import components, grams, near
from eventloom.llm.queries import op10_near_copies


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """rows: (id, text) with distinct ids -> {id: (set size, component)}."""
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for j, n in collections.Counter(j for s in sets[i] for j in holders[s]).items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def agree(found, rows):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute(rows)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    agree(op10_near_copies(spark, "/root/testdata/sf0.01"), rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies(spark, monkeypatch, seed):
    """Edits of one text around the limit, a passage that all share, exact copies, short texts; in small batches and chunks."""
    monkeypatch.setattr(grams, "BATCH", 20_000)
    monkeypatch.setattr(near, "CHUNK", 40)
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(3000)]
    base, passage = rng.choices(words, k=60), " ".join(rng.choices(words, k=30))
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w[rng.randint(0, 3) :]))
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(100)]
    texts += rng.choices(texts, k=40) + [" ".join(rng.choices(words[:3], k=rng.randint(0, 5))) for _ in range(40)] + ["", None, " \n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    agree(near.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)


def test_bound_never_loses_a_similar_set():
    rng = np.random.default_rng(0)
    sets = [rng.choice(4000, 300, replace=False) for _ in range(4)]
    sets += [np.unique(np.concatenate((s[: 300 - cut], rng.choice(4000, cut)))) for s in list(sets) for cut in range(0, 80, 2)]
    points = np.stack([np.bincount(s % near.GROUPS, minlength=near.GROUPS) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree, pruned = near.Tree(points, sizes), 0
    for k, s in enumerate(sets):
        found = set(tree.search(points[k], sizes[k])[0].tolist())
        assert {j for j, t in enumerate(sets) if near.similar(len(np.intersect1d(s, t)), len(s), len(t))} <= found
        pruned += len(sets) - len(found)
    assert pruned > 0.5 * len(sets) ** 2


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    got = near.near_copies(clashing).collect()
    assert len(got) == odd_docs.count()
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None}
    assert rows[4] == rows[5] and rows[4][1] == 4 and rows[9] == (0, 9) and rows[8] == (0, 8) and rows[7] == (0, 7) and rows[3] == (1, 3)
    assert sorted((r["n_shingles"], r["component_id"] is None) for r in got if r["doc_id"] is None) == [(0, True), (rows[4][0] + 4, False)]
    assert near.near_copies(no_docs).count() == 0
    kept = near.drop_near_copies(clashing)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == [None] and near.drop_near_copies(no_docs).count() == 0


def test_one_row_of_each_component_stays(spark):
    one, other = ("the cat sat on the mat and looked at the moon", "every harbour has a quay and a lamp that burns at night")
    rows = [(None, one), (None, one), (3, one), (3, one), (2, one), (None, other), (None, other), (5, ""), (5, ""), (2, other + " long")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long")
    got = near.drop_near_copies(docs.repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(2, one), (5, ""), (5, ""), (2, other + " long")])


def test_only_strays_are_compared_in_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 50)
    rows = [(0, k, 0) for k in range(1000)] + [(0, 1000, 1), (0, 1001, 2)] + [(1, k, 7) for k in range(500)] + [(2, k, k) for k in range(20)]
    got = near.dealt(spark.createDataFrame(rows, "bucket long, cid long, label long")).collect()
    assert {r["bucket"] for r in got} == {0, 2} and sum(r["bucket"] == 0 for r in got) == 1000 + 2 * 20 + 2 and sum(r["bucket"] == 2 for r in got) == 20
    many = [(0, k, 0 if k % 2 else k) for k in range(400)]
    groups = collections.defaultdict(list)
    for r in near.dealt(spark.createDataFrame(many, "bucket long, cid long, label long")).collect():
        groups[r["kind"], r["i"], r["j"]].append(r)
    met = set()
    for (kind, i, j), members in groups.items():
        left, right = ([r["cid"] for r in members if r["side"] == k] for k in ((0, 1) if kind == 1 else (i, j)))
        assert len(left) + len(right) < 200
        met |= {frozenset((a, b)) for a in left for b in right if a != b}
    label = {k: x for _, k, x in many}
    assert {frozenset((a, b)) for a in label for b in label if label[a] != label[b]} <= met


def test_sets_of_one_hash_are_told_apart(spark):
    found = spark.createDataFrame([(1, 10, 5), (2, 10, 5), (3, 10, 6), (4, 11, 5), (5, None, None)], "id long, cid long, check long")
    got = {r["id"]: r["cid"] for r in near.told_apart(found).collect()}
    assert got[1] == got[2] == 10 and got[3] not in (10, 11) and got[4] == 11 and got[5] is None


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7), (None, 3), (50, 51), (50, 51)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90, 50: 50, 51: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    labels = components.components(spark.createDataFrame(chain, "a long, b long"))
    more = spark.createDataFrame([(40, 95), (200, 201), (51, 199), (199, 202)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.merged(labels, more).collect()}
    assert got == {**{k: 0 for k in [*range(41), 90, 95, 100]}, 50: 50, 51: 50, 199: 50, 202: 50, 200: 200, 201: 200}
