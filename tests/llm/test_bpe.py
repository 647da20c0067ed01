import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import bpe
from eventloom.llm.queries import op3_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_query_equals_tiktoken(spark, sf_dir, exact):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = exact.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(ids), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", " \n ", "a  \n b\n\n c \t d   ", "x \n", "it's  <|endoftext|> 12 ½²Ⅳ", "é̀ 日本語   q", "  a　 b", "a\r\n  b", "tail  "])
def test_white_space(text, exact):
    (ids,) = bpe.Codec(PATH).encode([text])
    assert ids.tolist() == exact.encode_ordinary(text)


def test_chunks_in_use_outlive_a_full_table(exact, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CHUNKS", 40)
    codec, learned = bpe.Codec(PATH), []
    learn, codec.learn = codec.learn, lambda new: (learned.extend(new), learn(new))
    common = [f"wort{k}é," for k in range(20)]
    for n in range(12):
        text = "x " + " ".join(common + [f"neu{n}q{k}\n \tb{k} c" for k in range(20)])
        (ids,) = codec.encode([text])
        assert ids.tolist() == exact.encode_ordinary(text)
    assert sum(c in common for c in learned) == len(common)
    assert max(len(codec.kept), len(codec.before)) <= 40 + 3 * 20 + len(common)


def test_words_are_encoded_once_whatever_stands_after_them(exact):
    codec, sent = bpe.Codec(PATH), []
    real = codec.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return real.encode_batch_fast(texts, **options)

    codec.tokenizer = Counted()
    words = [f"w{a}{b}rt" for a in "aeiou" for b in "bcdfgh"]
    texts = [f"x {w}{m} {w}\n{w}{n}" for w in words for m in (",", ".", "!", '."') for n in ("", "...", "?\n \tq")]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == exact.encode_ordinary(text)
    assert sum(map(len, sent)) <= 2 * sum(len(w) + 1 for w in words) + 100
    del sent[:]
    assert [x.tolist() for x in codec.encode(texts)] == [exact.encode_ordinary(t) for t in texts] and not "".join(sent)


PARTS = st.sampled_from([*" \n\t\r\v\f\x1c\x1f\x00\x7f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\u180e\u0300_-,.'7²é日…😀", "  ", "Word", "'re", "'s", "##"])


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=6))
def test_any_characters_side_by_side(exact, texts):
    nulls = pa.array([None, *texts, None], pa.string())
    wanted = [exact.encode_ordinary(t) for t in texts]
    codec = bpe.codec(PATH)
    assert [x.tolist() for x in codec.encode(texts)] == wanted
    assert [x.tolist() for x in codec.encode(nulls)] == [[], *wanted, []] and [x.tolist() for x in codec.encode(nulls.slice(1, len(texts)))] == wanted


def test_offsets_and_split_characters():
    codec = bpe.Codec(PATH)
    text = "naïve 日本 \U0001f600!"
    (ids,) = codec.encode([text])
    starts, ends = codec.offsets(text, ids)
    raw, at = text.encode(), 0
    for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
        at += len(codec.pieces[i])
        assert raw[:at] in (text[:b].encode(), raw[:at]) and codec.pieces[i] in text[a:b].encode()
    assert codec.text(ids) == text
    cut = next(k for k in range(len(ids)) if codec.decode(ids[:k]).decode("utf-8", "ignore") != codec.decode(ids[:k]).decode("utf-8", "replace"))
    assert codec.text(ids[:cut]).endswith("�")


def test_round_trip_of_odd_rows(odd_docs, no_docs, clashing):
    got = bpe.decode(bpe.encode(clashing, PATH), PATH).collect()
    assert len(got) == clashing.count() and all(r["decoded"] == (r["text"] or "") and r["rank"] == 7 for r in got)
    assert all(len(r["bpe_ids"]) == len(r["bpe_starts"]) == len(r["bpe_ends"]) for r in got)
    assert bpe.digests(no_docs, PATH).count() == 0 and bpe.encode(no_docs, PATH).count() == 0
    assert {r["n_tokens"] for r in bpe.digests(odd_docs.where("text is null or text = ''"), PATH).collect()} == {0}
