import collections
import math
import re

import pytest

from eventloom.llm import grams, lm
from eventloom.llm.queries import op5_lm_score, op5_lm_score_bigrams


def brute(texts, order):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    parts = lambda w: collections.Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = collections.Counter()
    for w in docs:
        total.update(parts(w))
    words, out = sum(map(len, docs)), []
    for w in docs:
        own, score, steps = parts(w), 0.0, 0
        count = lambda g: total[g] - own[g]  # noqa: B023, E731
        for k in range(len(w)):
            longest = min(order, k + 1)
            n = next((n for n in range(longest, 1, -1) if count(tuple(w[k - n + 1 : k + 1])) > 0), 1)
            gram = tuple(w[k - n + 1 : k + 1])
            score += math.log(count(gram) / count(gram[:-1])) if n > 1 else math.log(max(count(gram), 0.5) / max(words - len(w), 1))
            score += (longest - n) * math.log(lm.BACKOFF)
            steps += n < longest
        out.append((len(w), steps, score))
    return out


def same(got, wanted, near=1e-9):
    assert len(got) == len(wanted)
    for a, b in zip(sorted(got), sorted(wanted), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=near)


def test_query(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same([tuple(r)[1:] for r in op5_lm_score(spark, sf_dir).collect()], brute(texts, lm.ORDER), 6e-5)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_many_batches_and_odd_rows(odd_docs, no_docs, clashing, monkeypatch, order):
    monkeypatch.setattr(grams, "BATCH", 700)
    texts = [r["text"] for r in odd_docs.collect()]
    same([tuple(r)[1:] for r in lm.score_documents(clashing, order=order).collect()], brute(texts, order))
    assert lm.score_documents(no_docs, order=order).count() == 0
    if order == 3:  # a batch for each document and more, and parts as many
        monkeypatch.setattr(grams, "BATCH", 1)
        same([tuple(r)[1:] for r in lm.score_documents(odd_docs).collect()], brute(texts, order))


def test_trigrams_are_the_default(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r["text"] for r in docs.collect()]
    want = brute(texts, 3)
    assert want != brute(texts, 2)
    same([tuple(r)[1:] for r in op5_lm_score_bigrams(spark, sf_dir).collect()], brute(texts, 2), 6e-5)
    same([tuple(r)[1:] for r in lm.score_documents(docs).collect()], want)


def test_shuffle_files_go_as_soon_as_sums_are_stored(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, switch = files(), spark.conf.get(grams.CLEANUP)
    found = grams.stored_alone(spark.range(1000).selectExpr("id % 97 as x").groupBy("x").count())
    assert not files() - before and spark.conf.get(grams.CLEANUP) == switch
    assert found.count() == 97 and files() - before
