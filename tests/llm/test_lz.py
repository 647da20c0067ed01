import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import lz
from eventloom.llm.common import BASE
from eventloom.llm.queries import op1_lz_fingerprint


def phrases(text):
    seen, start, ends = set(), 0, []
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            ends.append(end)
            start = end
    return ends


@settings(deadline=None, max_examples=60)
@given(st.text("abc ", max_size=120), st.text("abc ", max_size=60), st.integers(0, 120))
def test_parse_is_the_dictionary_parse(text, tail, cut):
    parse = lz.Parse()
    parse.feed(text)
    assert parse.ends == phrases(text)
    cut = min(cut, len(text))
    whole, edited = lz.fingerprints(text, cut, tail)
    assert whole.tolist() == lz.fingerprint(text).tolist() and edited.tolist() == lz.fingerprint(text[:cut] + tail).tolist()


def test_one_dictionary_for_a_whole_text():
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh \u00e9\U0001f600", k=900_000))
    parse = lz.Parse()
    parse.feed(text)
    assert parse.ends == phrases(text)
    a, b = lz.fingerprints(text, 600_000, "xyz" * 1000)
    assert lz.hexed(a) == sketch(text) and lz.hexed(b) == sketch(text[:600_000] + "xyz" * 1000)


def test_likeness_is_the_share_of_common_phrases():
    a, b = "the cat sat on the mat", "the cat sat on the rug"
    x, y = ({t[s:e] for s, e in zip([0, *phrases(t)], phrases(t))} for t in (a, b))
    assert lz.likeness(lz.fingerprint(a), lz.fingerprint(b)) == pytest.approx(len(x & y) / len(x | y))
    assert lz.likeness(lz.fingerprint(""), lz.fingerprint("")) == 1 and lz.likeness(lz.fingerprint(""), lz.fingerprint("a")) == 0


LIMIT = 1 << 64


def spread(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % LIMIT
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % LIMIT
    return x ^ (x >> 31)


def sketch(text, size=lz.SIZE):
    """The fingerprint once more: phrases from a set of seen ones, each hashed in plain numbers."""
    found, start = set(), 0
    for end in phrases(text):
        h, power = 0, 1
        for c in text[start:end]:
            h, power = (h + (ord(c) + 1) * power) % LIMIT, power * BASE % LIMIT
        found.add(spread((h + (end - start) * 0xD6E8FEB86659FD93) % LIMIT))
        start = end
    return "".join(f"{h:016x}" for h in sorted(found)[:size])


def alike(a, b, size=lz.SIZE):
    a, b = ({x[k : k + 16] for k in range(0, len(x), 16)} for x in (a, b))
    both = sorted(a | b)[:size]
    return len(a & b & set(both)) / len(both) if both else 1.0


def brute(rows):
    """rows: (id, text) -> sorted results."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).digest()))
    out, known = [], {}

    def of(t):
        return known.setdefault(t, None) or known.update({t: sketch(t)}) or known[t]

    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) - len(t) // 3
        edited = t[:cut] + following[: len(t) - cut]
        a, b, c = map(of, (t, edited, following))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op1_lz_fingerprint(spark, sf_dir).collect()), key=repr) == brute(rows)


def test_many_ranges_and_odd_rows(odd_docs, no_docs, clashing, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for most in (500, 2, 1):
        monkeypatch.setattr(lz, "PER_RANGE", most)
        assert sorted((tuple(r) for r in lz.edited_pairs(clashing).collect()), key=repr) == brute(rows)
    assert lz.edited_pairs(no_docs).count() == 0


def test_ids_of_many_rows_have_ranges_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(lz, "PER_RANGE", 5)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcd ", k=rng.randint(0, 30)))
    rows = [(k, word()) for k in range(40)] + [(17, word()) for _ in range(60)] + [(None, word()) for _ in range(60)] + [(3, "same")] * 30
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in lz.edited_pairs(docs).collect()), key=repr) == brute(rows)
    sizes = [r["count"] for r in lz.neighbours(docs, "doc_id", "text").where("not guest and (id is null or id != 3)").groupBy("range").count().collect()]
    assert max(sizes) < 25 and len(sizes) > 20


def test_single_rows_and_fingerprints(odd_docs, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    one = odd_docs.where("doc_id = 3")
    assert [tuple(r) for r in lz.edited_pairs(one).collect()] == brute([(3, "word")])
    got = lz.with_fingerprint(clashing).collect()
    assert len(got) == len(rows) and all(r["fingerprint"] == lz.hexed(lz.fingerprint(r["text"] or "")) and r["score"] == 3 for r in got)
