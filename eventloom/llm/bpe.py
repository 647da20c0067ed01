"""Byte-level BPE encoding and decoding over Arrow batches, with byte and character offsets."""

from __future__ import annotations

import functools
import hashlib
import json
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm.common import KEPT, slices

#: White space, by the length of its characters in UTF-8. BLANK: what every library takes for white space. LETTER and MARK: of ASCII.
SPACES = [[c.encode() for c in map(chr, range(0x3001)) if c.isspace() and len(c.encode()) == n] for n in (1, 2, 3)]
BLANK = " \t\n\v\f\r"
LETTER, MARK = string.ascii_letters, string.punctuation
#: Encoded chunks that a worker keeps before it starts afresh; so many more are those of before, of which it takes over what is used again.
MOST_CHUNKS = 400_000


@functools.cache
def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level tokenizer file with its byte table. Encoded chunks are kept, as corpora repeat them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        reverse = byte_chars()
        self.pieces: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in reverse for c in token):
                self.pieces[i] = bytes(reverse[c] for c in token)
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        KEPT.extend((self.kept, self.before))

    @staticmethod
    def cuts(data: np.ndarray) -> np.ndarray:
        """Where in UTF-8 bytes a match of the pre-tokenizer surely starts: at white space after what is none, and at a mark after a letter."""
        kind = np.zeros(256, dtype=np.uint8)
        for k, of in enumerate((BLANK, LETTER, MARK), 1):
            kind[list(of.encode())] = k
        kinds = kind[data]
        at = np.flatnonzero(kinds[1:] == 1) + 1
        last = data[at - 1]
        narrow = np.zeros(256, dtype=bool)
        narrow[[c[0] for c in SPACES[0]]] = True
        keep = ~narrow[last]
        wide = np.flatnonzero(last >= 0x80)
        code = data[at[wide] - 2].astype(np.int64) << 8 | last[wide]
        keep[wide[np.isin(code, [int.from_bytes(c) for c in SPACES[1]])]] = False
        code |= data[at[wide] - 3].astype(np.int64) << 16  # of a character of two bytes it is no code of three, whatever stands there
        keep[wide[np.isin(code, [int.from_bytes(c) for c in SPACES[2]])]] = False
        return np.concatenate((at[keep], np.flatnonzero((kinds[:-1] == 2) & (kinds[1:] == 3)) + 1))

    def learn(self, new: set[str]) -> None:
        """Keep the ids of chunks that follow a blank."""
        self.keep([" " + c for c in new])

    def keep(self, new: list[str]) -> None:
        """Keep the ids of chunks."""
        odd = [c for c in new if c[-1].isspace() or (c[0].isspace() and c[0] not in BLANK)]
        plain = list(set(new).difference(odd))  # any two of these may stand side by side, if one that starts without white space gets some
        for begin in range(0, len(plain), 2048):
            part = plain[begin : begin + 2048]
            apart = [c[0] not in BLANK for c in part]
            joined = pa.array(["\n" + c if x else c for x, c in zip(apart, part, strict=True)], pa.large_string())
            (found,) = self.tokenizer.encode_batch_fast([joined.buffers()[2].to_pybytes().decode()], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            edges = np.frombuffer(joined.buffers()[1], dtype=np.int64, count=len(part) + 1)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), edges[1:]) + 1
            begins, raw = np.append(0, ends[:-1]) + apart, ids.tobytes()
            for c, a, b in zip(part, (4 * begins).tolist(), (4 * ends).tolist(), strict=True):
                self.kept[c] = raw[a:b]
        for c, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.kept[c] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: empty) as little-endian unsigned 32-bit integers.

        Texts are cut to chunks, equal ones are brought together, and only different ones are looked up or encoded.
        """
        if len(self.kept) > MOST_CHUNKS:
            self.kept, self.before = self.before, self.kept
            self.kept.clear()
        texts = pc.fill_null(texts, "").cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        begins = np.frombuffer(texts.buffers()[1] or bytes(8), dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[begins[0] : begins[-1]]
        begins = begins - begins[0]
        starting = np.zeros(len(data) + 1, dtype=bool)
        starting[self.cuts(data)] = True
        starting[begins] = True
        edges = np.flatnonzero(starting)  # the last is the end, as that is where the last text ends
        chunks = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        coded = self.coded(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()).take(chunks.indices)
        ends = np.frombuffer(coded.buffers()[1], dtype=np.int64, count=len(edges)) // 4
        ids = np.frombuffer(coded.buffers()[2] or b"", dtype="<u4")
        of_text = ends[np.searchsorted(edges, begins)]
        return [ids[a:b] for a, b in zip(of_text.tolist(), of_text[1:].tolist(), strict=False)]

    def coded(self, chunks: list[str]) -> pa.Array:
        """The ids of different chunks as bytes."""
        found = list(map(self.kept.get, chunks))
        lacking = [k for k, x in enumerate(found) if x is None]
        again = {c: self.before[c] for k in lacking if (c := chunks[k]) in self.before}
        self.kept.update(again)
        new = [c for k in lacking if (c := chunks[k]) not in again]
        self.learn({c[1:] for c in new if c[0] == " "})
        self.keep([c for c in new if c[0] != " "])
        for k in lacking:
            found[k] = self.kept[chunks[k]]
        return pa.array(found, pa.large_binary())

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids. They may end within a character: read them with text()."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def text(self, ids: np.ndarray) -> str:
        """The decoded text; a character of which only a part is there becomes U+FFFD."""
        return self.decode(ids).decode("utf-8", errors="replace")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token. Tokens that share a split character each cover it."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        return char[starts], char[ends - 1] + 1


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_batches(batches: Iterable[pa.RecordBatch], path: str, text: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Each slice of the batches with its texts (null: empty) and their ids."""
    own = codec(path)
    for batch in slices(batches, text, 1_000_000, keep=True):
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        yield batch, texts, own.encode(texts)


def encode(docs: DataFrame, path: str, text: str = "text", offsets: bool = True, prefix: str = "bpe") -> DataFrame:
    """docs with the columns {prefix}_ids array<int>, and {prefix}_starts and {prefix}_ends array<int> (character offsets).

    A null or empty text has empty arrays. Columns of docs with the same names are replaced; other columns stay.
    Repeated rows stay repeated. An empty table gives an empty table. Each text is encoded whole, in one task.
    """
    names = [f"{prefix}_ids", *([f"{prefix}_starts", f"{prefix}_ends"] if offsets else [])]
    docs = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` array<int>" for n in names)])

    def run(batches):
        for batch, texts, ids in encode_batches(batches, path, text):
            columns = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
            if offsets:
                pairs = [codec(path).offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                columns += [pa.array([p[k].astype(np.int32) for p in pairs], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "bpe_ids", to: str = "decoded") -> DataFrame:
    """encoded with the column `to`: the decoded text of the ids (null ids: null; a split character: U+FFFD).

    No ids give an empty text. Every row stays, repeated rows too; a column of that name is replaced, others may have any name; ids of
    very long texts are decoded whole; an empty table stays empty.
    """
    encoded = encoded.drop(to)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{to}` string"])

    def run(batches):
        own = codec(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if x is None else own.text(np.array(x, dtype=np.int64)) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, to])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 of the text's ids and of what they decode to (null: empty text).

    An empty text has no ids. Null ids of rows stay null; repeated rows stay repeated; very long texts are encoded whole; an empty
    table gives no rows.
    """

    def run(batches):
        own = codec(path)
        for batch, _, ids in encode_batches(batches, path, text):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(id_col)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text))
    return docs.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())
