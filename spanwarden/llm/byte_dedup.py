"""Substring dedup over bytes: remove whatever a string of ``length`` bytes covers that also starts earlier.

Prefix-free parsing, distributed. Rolling-hash triggers (the least hash of ``gram`` bytes within reach, so that phrases are bounded)
cut every document into phrases; the trigger that ends one phrase begins the next. Phrases whose trigger has one surrounding
in the whole corpus cannot repeat in part and are left out of the sorting (``windows``). For the others Spark brings all that share
a trigger together, and ``corpus_order`` sorts twice:

* the dictionary: the phrases before the trigger by their suffixes, with the longest common suffix of neighbours;
* the parse: the trigger and the phrases that follow it, with the longest common prefix of neighbours.

A string that starts j bytes before the trigger is a suffix of j bytes of a dictionary phrase and a prefix of the parse, so the pair of
its ranks at these depths is its place in corpus order; strings of one place are equal byte by byte, and the first of them by
document and position stays. "Earlier" is a smaller doc_id, or the same document and an earlier start; overlaps count and
strings are judged on the input.

Null text counts as empty; rows without an id are compared with nothing and keep all; rows that share an id count as
one document. Extra columns of the input are ignored; an empty table gives an empty result. Ids must be integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import Kind, covered, repeated_spans, runs_of, sorted_rows, span_lists

LENGTH = 100
GRAM = 32


def corpus_order(kind: Kind, gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, lhs: np.ndarray, rhs: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and intervals of strings that are not the first of their place in corpus order."""
    n, before = len(gram), kind.reach - 1
    by_suffix, common_suffix = sorted_rows(gram, cells[:, :before][:, ::-1])  # the dictionary
    by_prefix, common_prefix = sorted_rows(gram, cells[:, before:])  # the parse
    dictionary, parse = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    rows, starts = [], []
    for j in range(kind.reach):
        whole = np.flatnonzero((j <= lhs) & (kind.length - j <= rhs))
        if len(whole) < 2:
            continue
        dictionary[by_suffix] = np.cumsum(common_suffix < j)
        parse[by_prefix] = np.cumsum(common_prefix < kind.length - j)
        place = dictionary[whole] * (n + 1) + parse[whole]
        _, first, at = np.unique(place, return_index=True, return_inverse=True)
        first = whole[first][at]  # rows are in order of document and position
        again = (doc[whole] != doc[first]) | (pos[whole] != pos[first])
        rows.append(whole[again]), starts.append(pos[whole[again]] - j)
    row, start = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, starts))
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    cut = np.ones(len(row), dtype=bool)  # neighbouring starts of one row make one interval
    cut[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    a = np.flatnonzero(cut)
    last = np.append(a[1:], len(row)) - 1 if len(a) else a
    return row[a], start[a], start[last] + kind.length


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, removed (start and end of the maximal runs), kept_sha256."""
    kind = Kind("byte", length, min(gram, length), own=True)

    def finish(batches):
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                texts = batch.column(1).cast(pa.large_binary()).to_pylist()
                n, removed, runs, digests = [], [], [], []
                for text, spans in zip(texts, span_lists(batch), strict=True):
                    data = np.frombuffer(text or b"", dtype=np.uint8)
                    mask = covered(len(data), spans)
                    n.append(len(data)), removed.append(int(mask.sum())), runs.append([{"start": int(a), "end": int(b)} for a, b in runs_of(mask)])
                    digests.append(hashlib.sha256(data[~mask].tobytes()).hexdigest())
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, kinds), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return repeated_spans(kind, docs, corpus_order, finish, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string")
