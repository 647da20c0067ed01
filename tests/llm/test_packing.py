import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventloom.llm import packing
from eventloom.llm.queries import op7_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_uses_each_length_as_often_as_it_is_there(lengths):
    counts = np.bincount(lengths, minlength=25)[:25] if lengths else np.zeros(25, dtype=int)
    used = np.zeros(25, dtype=int)
    for pattern, k in packing.plan(counts, 24):
        assert k > 0 and 0 < sum(pattern) <= 24
        for v in pattern:
            used[v] += k
    assert (used == counts).all()


def test_fit_is_least_squares_and_patterns_take_most():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 64, 20_000), minlength=65)
    patterns = packing.candidates(counts, 64)
    assert (patterns.sum(axis=1) == 64).all()
    x = packing.fit(counts.astype(float), patterns)
    m = np.zeros((65, len(patterns)))
    for k in range(3):
        np.add.at(m, (patterns[:, k], np.arange(len(patterns))), 1.0)
    m[0] = 0
    slope = m.T @ (m @ x - counts) / counts.max()
    assert (x >= 0).all() and slope.min() > -1e-3 and np.abs(slope[x > 1]).max() < 1e-3
    planned = packing.plan(counts, 64)
    least = -(-int((counts * np.arange(65)).sum()) // 64)
    assert sum(k for _, k in planned) <= 1.001 * sum(k for _, k in packing.best_fit(counts, 64)) + 1
    assert sum(k for p, k in planned if sum(p) == 64) > 0.9 * least


def check(rows, texts, capacity=1024, end=2):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    wanted = []
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        first = len(ids) % capacity or min(capacity, len(ids))
        edges = [0, *range(first, len(ids) + 1, capacity)]
        wanted += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=repr) == sorted(wanted, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_query(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n, least = check(op7_packing(spark, sf_dir).collect(), texts)
    assert n <= least * 1.005 + 2


@pytest.mark.parametrize("capacity", [1, 7, 1024])
def test_odd_rows(odd_docs, no_docs, clashing, capacity):
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(packing.pack_documents(clashing, PATH, capacity).collect(), texts, capacity)
    assert packing.pack_documents(no_docs, PATH, capacity).count() == 0


def test_one_length_is_ranked_in_many_groups(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "'same text' as text")
    rows = packing.pack_documents(docs, PATH, 1024).collect()
    n, least = check(rows, [(k, "same text") for k in range(9000)])
    assert n == -(-9000 // (1024 // rows[0]["length"])) and n <= least + 1
