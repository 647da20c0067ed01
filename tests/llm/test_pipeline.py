import sys

import pytest

from eventloom.llm import quality, secrets
from tests.llm.test_near import brute as components
from tests.llm.test_packing import check

sys.path.insert(0, ".")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_stages_take_odd_rows(spark, sf_dir, odd_docs, no_docs, clashing, which, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""
    docs = {"odd": odd_docs, "none": no_docs, "clashing": clashing}[which]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "near copies":
            texts = [r["text"] for r in docs.collect()]
            copies = {t for t in texts if t and t.startswith("The harbour")}
            assert out.count() == len(texts) - sum(bool(t) and t.startswith("The harbour") for t in texts) + bool(copies)
        if name == "secrets":
            assert sorted(map(repr, (r["text"] for r in out.collect()))) == sorted(map(repr, (r["text"] for r in docs.collect())))
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
        if name == "packing":
            assert {repr(r["doc_id"]) for r in out.collect()} == {repr(r["doc_id"]) for r in docs.collect()}
        docs = out if which == "odd" and name != "packing" else docs


def test_run_leaves_no_intermediate_tables(spark, sf_dir):
    from eventloom.llm import common

    before = set(common.MADE)
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and len(set(common.MADE) - before) <= 4


def test_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    good = {i: r["text"] for i, r in rows.items() if scores[i] >= quality.LEAST}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "secrets", "packing"]
    by_stage = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage{len(by_stage)}"
        stage(spark, by_stage[-1], sf).write.mode("overwrite").parquet(path)
        by_stage.append(spark.read.parquet(path))
        assert by_stage[-1].columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in by_stage[1].collect()} == good
    groups = components(list(good.items()))
    kept = {i: t for i, t in good.items() if groups[i][1] == i}
    assert {r["doc_id"]: r["text"] for r in by_stage[2].collect()} == kept and len(kept) < len(good)
    masked = {}
    for i, t in kept.items():
        spans, out, at = secrets.find(t or ""), "", 0
        for a, b, kind in spans:
            if a >= at:
                out += (t or "")[at:a] + f"[{kind}]"
            at = max(at, b)
        masked[i] = out + t[at:] if t is not None else None
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["lang"], r["source"]) for r in by_stage[3].collect()}
    assert got == {i: (t, None if t is None else len(t), rows[i]["lang"], rows[i]["source"]) for i, t in masked.items()} and masked != kept
    n, least = check(corpus_pipeline.run(spark, sf).collect(), list(masked.items()))
    assert n <= least * 1.02 + 2
