"""Secret scans with a ledger of blobs: each distinct text is scanned once for each version of each rule."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import salted, slices, stored, unused

#: The rules by name, in the order in which spans of one start are listed. Of each: its version, its pattern,
#: what a text must hold (in lower case) for the pattern to be tried, the group that is measured and its least length.
RULES: dict[str, tuple[int, re.Pattern, tuple[str, ...], int, int]] = {
    "assign": (1, re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), ("passw", "secret", "token", "api"), 2, 12),
    "access": (1, re.compile(r"AKIA[A-Z0-9]+"), ("akia",), 0, 18),
    "hex": (1, re.compile(r"[0-9a-f]{16,}"), (), 0, 16),
    "github": (1, re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), 0, 40),
    "jwt": (1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("eyj",), 0, 29),
    "pem": (1, re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), ("private key",), 0, 27),
}
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind: string, start: int, end: int>>"
#: Blobs that a task remembers as already sent on.
MOST_SENT = 200_000


def find(text: str, rules: Iterable[str] = tuple(RULES)) -> list[tuple[int, int, str]]:
    """The spans (start, end, kind) of some rules in code points, by start and then in the rules' order."""
    low, order, found = text.lower(), list(RULES), []
    for kind in rules:
        _, pattern, needs, group, least = RULES[kind]
        if not needs or any(x in low for x in needs):
            found += [(m.start(), order.index(kind), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def address(text: Column) -> Column:
    """The content address of a blob; a null text has that of an empty one."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def sent_blobs(versions: DataFrame, text: str) -> DataFrame:
    """blob, body (compressed): each task sends a text on once, so that many copies are one row per task."""

    def run(batches):
        sent: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, text):
            blobs, bodies = [], []
            for t in batch.column(0).to_pylist():
                raw = (t or "").encode()
                key = hashlib.sha256(raw)
                if key.digest() in sent:
                    continue
                if len(sent) >= MOST_SENT:
                    sent.clear()
                sent.add(key.digest())
                blobs.append(key.hexdigest())
                bodies.append(pack(raw))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(bodies, pa.binary())], names=["blob", "body"])

    return versions.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "blob string, body binary")


def scan_unseen(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows: blob, rule, version, spans; exactly one for each pair of a blob and a rule version that `ledger` lacks.

    versions: a row for each version of each file, of any age; null texts count as empty. ledger: what earlier calls returned
    (columns blob, rule, version; repeated rows count once), or None. What a blob is known for and its copies, one a task at
    most, meet by address, the known first, and are read in that order: so each blob is scanned once, however many copies
    there are and however tasks are dealt. Pairs without a finding have empty spans, so that they need not be scanned again.
    Texts of any length are scanned whole. An empty table gives no rows.
    """
    rows = sent_blobs(versions, text).withColumn("seen", F.lit(None).cast("string"))
    if ledger is not None:
        pairs = F.concat_ws("@", "rule", F.col("version").cast("string"))
        seen = ledger.where("blob is not null").groupBy("blob").agg(F.array_join(F.collect_set(pairs), " ").alias("seen"))
        rows = rows.unionByName(seen.select("blob", F.lit(None).cast("binary").alias("body"), "seen"))
    rows = rows.repartition("blob").sortWithinPartitions("blob", F.col("seen").asc_nulls_last())

    def run(batches):
        last, known = None, frozenset()  # the blob before, and the pairs that need no scan
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "body", 1_000_000):
            out: dict[str, list] = {"blob": [], "rule": [], "version": [], "spans": []}
            for blob, body, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blob != last:
                    last, known = blob, frozenset((seen or "").split())
                todo = [k for k in RULES if f"{k}@{RULES[k][0]}" not in known]
                if body is None or not todo:
                    continue
                known = known | {f"{k}@{RULES[k][0]}" for k in todo}
                found = find(unpack(body).decode(), todo)
                for k in todo:
                    out["blob"].append(blob)
                    out["rule"].append(k)
                    out["version"].append(RULES[k][0])
                    out["spans"].append([{"start": a, "end": b} for a, b, kind in found if kind == k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["blob"], pa.string()), pa.array(out["rule"], pa.string()), pa.array(out["version"], pa.int32()), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=list(out),
            )

    return rows.mapInArrow(run, "blob string, rule string, version int, spans array<struct<start: int, end: int>>")


def findings(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, to: str = "secrets") -> DataFrame:
    """versions with the column `to`: all spans of its text by the rules' present versions, by start and then rule.

    Every row of versions stays, repeated rows too; a column of that name is replaced, other columns may have any name; texts
    that are null or without a finding have an empty array. Equal texts have equal spans, whichever path or age they have.
    Very long texts are scanned whole; an empty table stays empty.
    """
    new = scan_unseen(versions, text, ledger)
    known = new if ledger is None else new.unionByName(ledger.select("blob", "rule", "version", "spans"))
    current = F.create_map(*[x for k, r in RULES.items() for x in (F.lit(k), F.lit(r[0]))])
    rank = F.create_map(*[x for i, k in enumerate(RULES) for x in (F.lit(k), F.lit(i))])
    hits = (
        known.where((F.size("spans") > 0) & (F.col("version") == current[F.col("rule")]))
        .select("blob", "rule", F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("s.start", rank[F.col("rule")].alias("rank"), "s.end", F.col("rule").alias("kind")))).alias("found"))
        .select("blob", F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    )
    kept = versions.drop(to)
    blob, spans = unused(kept, "blob"), unused(kept, "found")  # columns of versions may have any name
    rows = kept.withColumn(blob, address(F.col(text)))
    return salted(rows, hits.toDF(blob, spans), blob, [c for c in kept.columns if c != text] or [text]).select(*kept.columns, F.coalesce(F.col(spans), F.array().cast(SPANS)).alias(to))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """Per document: how many spans of each base kind, the digest of the base spans, and all spans as text.

    Null, empty and very long texts, repeated rows and the ledger are as in findings(); a null id stays null; an empty table
    gives no rows.
    """
    spans = F.col("spans")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = findings(rows, "text", ledger, to="spans")
    return found.select(
        F.col("id").alias(id_col),
        *[F.size(of_kinds(spans, k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of_kinds(spans, *BASE)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def digests_in_two(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """digests() by a ledger that grows: about half of the documents are scanned into it first, then all against what it has.

    The ledger is written to the shared folder and read again; the second scan leaves out every blob that the first has seen.
    """
    early = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0)
    return digests(docs, id_col, text, stored(scan_unseen(early, text)))


def redact(docs: DataFrame, text: str = "text", mark: Callable[[str], str] = "[{}]".format) -> DataFrame:
    """docs with each run of overlapping spans replaced by the mark of its first kind; other columns and texts stay as they are.

    Null and empty texts stay; very long ones are scanned whole; every row stays, repeated rows too; an empty table stays
    empty. Columns may have any name.
    """
    names = docs.columns
    to = unused(docs, "spans")
    found = findings(docs, text, to=to)
    schema = docs.schema

    def run(batches):
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            spans = batch.column(batch.schema.get_field_index(to)).to_pylist()
            new = pa.array([t if not s else covered(t, s, mark) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == text else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return found.mapInArrow(run, schema)


def covered(text: str, spans: list[dict], mark: Callable[[str], str]) -> str:
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at : s["start"]], mark(s["kind"])]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])
