import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from eventloom.llm import quality
from eventloom.llm.common import BASE
from eventloom.llm.queries import op2_quality
from tests.llm.test_lz import LIMIT, spread


def test_held_out_accuracy(spark):
    found = op2_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert len(bad) and (good[:, None] > bad).mean() > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert found.count() == 1000


def test_held_out_labels_have_no_part(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.classify(docs, labels).collect())) == sorted(map(tuple, quality.classify(docs, turned).collect()))


def test_words_do_not_cross_texts():
    rows, first = quality.words(pa.array(["ab!!", None, "", "cd ab", "!!"]))
    assert first.tolist() == [0, 2, 2, 2, 4, 5] and rows[0] == rows[3] and rows[1] == rows[4]


def test_context_sums_equal_a_plain_count():
    texts = pa.array(["a b c d", "b"])
    sums = quality.context_sums([pa.RecordBatch.from_arrays([texts], names=["text"])], "text")
    rows, _ = quality.words(texts)
    places, signs = quality.index_vectors()
    plain = np.zeros((1 << quality.BITS, quality.DIM))
    for i in range(4):
        for j in range(max(0, i - 2), min(4, i + 3)):
            if i != j:
                for k in range(quality.TAPS):
                    plain[rows[i], places[rows[j], k]] += signs[rows[j], k]
    assert np.allclose(sums[:, :-1], plain) and sums[:, -1].sum() == 5


def plain_words(text, bits):
    """The words of a text as rows, in plain numbers."""
    out = []
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x20\x09-\x0d]+", (text or "").encode()):
        h, power = 0, 1
        for c in m[0]:
            h, power = (h + (c + 1) * power) % LIMIT, power * BASE % LIMIT
        out.append(spread((h + len(m[0]) * 0xD6E8FEB86659FD93) % LIMIT) >> (64 - bits))
    return out


def test_every_score_equals_a_plain_recomputation(spark, sf_dir):
    bits = 12
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where(~quality.is_held_out("doc_id")), bits=bits)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, bits=bits).collect()}
    rows = {r["doc_id"]: plain_words(r["text"], bits) for r in docs.collect()}
    places, signs = quality.index_vectors(bits)
    index = np.zeros((1 << bits, quality.DIM))
    for k in range(quality.TAPS):
        np.add.at(index, (np.arange(1 << bits), places[:, k]), signs[:, k])
    sums, counts = np.zeros_like(index), np.zeros(1 << bits)
    for w in rows.values():
        for i, x in enumerate(w):
            counts[x] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    sums[x] += index[w[j]]
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    rare = 1e-3 / (1e-3 + counts / counts.sum())
    w1, b1, w2, b2 = model.layers
    for i, w in rows.items():
        parts = [(m[w] * f).sum(axis=0) / max(1, len(w)) for m, f in ((unit, 1), (unit, rare[w, None]), (index, 1))]
        x = np.concatenate([*parts, [np.linalg.norm(parts[0]), np.linalg.norm(parts[2]), np.log(1 + len(w))]])
        logit = np.tanh((x - model.center) / model.scale @ w1 + b1) @ w2 + b2[0]
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(logit / model.temperature, -30, 30)))) < 1e-3, i


def test_ids_of_several_rows_count_once(spark):
    docs = spark.createDataFrame([(k % 50, f"good words {k % 7} here" if k % 2 else f"BAD!!! {k % 5} $$$") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    one, two = (quality.train(d, labels, bits=10) for d in (docs, docs.union(docs)))
    assert np.allclose(one.center, two.center, atol=1e-3) and quality.train(docs, labels, bits=10, most=20).layers


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    labels = spark.createDataFrame([(5, 1, 0), (4, 1, 0), (6, 0, 0), (3, 0, 1), (None, 1, 1), (2, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(clashing, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = labels.where("false")
    assert {r["score"] for r in quality.classify(odd_docs, none).collect()} == {0.5}
    assert {r["score"] for r in quality.classify(odd_docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.classify(no_docs, labels).count() == 0
    more = clashing.withColumns({n: F.lit(1) for n in ("__score", "__id", "__label", "held_out", "pools")})
    assert quality.keep_good(more, none).columns == more.columns
