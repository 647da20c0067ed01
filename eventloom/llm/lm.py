"""Stupid-backoff scores of documents by the n-gram counts of all other documents of the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import shared_dir, shingles
from eventloom.llm.grams import batches_of, joined_counts, opened

#: Words of the longest n-gram.
ORDER = 3
#: The factor of each step back, bytes of an n-gram's hash, and the level at which texts are compressed, as they are written twice.
BACKOFF, WIDTH, LEVEL = 0.4, 7, 9


def grams(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that lie within a document: their hashes, cut to WIDTH bytes, and where they begin."""
    found = shingles(words, n)
    ends = np.repeat(firsts[1:], np.diff(firsts))
    at = np.flatnonzero(np.arange(len(found)) + n <= ends[: len(found)])
    return found[at] >> np.uint64(64 - 8 * WIDTH), at


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: id, n_words, n_backoffs (words scored by a shorter n-gram than there could be) and log_score (natural, summed).

    A word's score is count(n-gram) / count(its first n - 1 words) for the longest n-gram up to `order` that other documents
    hold; each step back to a shorter one costs the factor BACKOFF; a word alone scores count / all words, where a count
    of 0 is taken for a half. Counts are those of the whole corpus less the document's own, so that no document vouches for
    itself; copies in other rows do. Words are runs of other than ASCII white space, A-Z as a-z. Null, empty and blank texts
    have no words and a score of 0; a corpus of one document leaves half a count for each word. Repeated rows stay
    repeated, and each counts. An empty table gives no rows.

    N-grams are told apart by hashes of 8 * WIDTH bits: of 10^9 different n-grams about 7 are taken for another one.
    """
    batches = batches_of(docs, id_col, text, shared_dir(docs.sparkSession), LEVEL)

    def keys_of(words, firsts):
        keys, adds = np.unique(np.concatenate([grams(words, firsts, n)[0] for n in range(1, order + 1)]), return_counts=True)
        return keys, adds, (words, firsts)

    def count_words(rows):
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([len(opened(b)[1]) for b in row.column(0).to_pylist()], pa.int64())], names=["n"])

    total = batches.select("body").mapInArrow(count_words, "n long").agg(F.sum("n")).first()[0] or 0

    def finish(ids, state, keys, totals):
        words, firsts = state
        n_docs, sizes = len(ids), np.diff(firsts)
        doc = np.repeat(np.arange(n_docs), sizes)
        others = []  # of each order: by the n-gram's first word, how often other documents hold it (-1: none begins there)
        for n in range(1, order + 1):
            found, at = grams(words, firsts, n)
            place = np.searchsorted(keys, found)
            _, inverse, own = np.unique(place * n_docs + doc[at], return_inverse=True, return_counts=True)
            counts = np.full(len(words), -1, dtype=np.int64)
            counts[at] = totals[place] - own[inverse]
            others.append(counts)
        rest = np.maximum(total - sizes[doc], 1)
        result = np.log(np.maximum(others[0], 0.5) / rest)
        place_in_doc = np.arange(len(words)) - firsts[:-1][doc]
        possible = np.minimum(place_in_doc + 1, order)  # the longest n-gram that ends here
        used = np.ones(len(words), dtype=np.int64)
        for n in range(2, order + 1):
            ends = np.arange(n - 1, len(words))
            begins = ends - (n - 1)
            whole, before = others[n - 1][begins], others[n - 2][begins]
            good = (possible[ends] >= n) & (whole > 0)
            result[ends[good]] = np.log(whole[good] / before[good])
            used[ends[good]] = n
        result += np.log(BACKOFF) * (possible - used)
        return pa.table(
            {
                id_col: ids,
                "n_words": pa.array(sizes.astype(np.int64)),
                "n_backoffs": pa.array(np.bincount(doc, used < possible, minlength=n_docs).astype(np.int64)),
                "log_score": pa.array(np.bincount(doc, result, minlength=n_docs).astype(np.float64)),
            }
        )

    return joined_counts(batches, keys_of, finish, f"`{id_col}` long, n_words long, n_backoffs long, log_score double", WIDTH, alone=True)
