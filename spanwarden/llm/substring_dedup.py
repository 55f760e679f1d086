"""Substring dedup over words by relative Lempel-Ziv factors against reference blocks.

Every document is factored against all documents with smaller ids. The reference is indexed in blocks: a block holds all places of the
corpus whose anchor (the least hash of ``gram`` words within reach) is the same, with the words around them in sorted order.
A document meets each block that holds one of its anchors, by a shuffle; in other blocks it has no factor of ``window`` words,
since a match of that length has the anchor of its words. Places whose whole surroundings occurred in an earlier document
need no factoring (``windows``).

In a block a place is factored greedily: from the leftmost start that has a match in an earlier document, the longest such match is the
factor. Starts whose ``window`` words end beyond the factor are checked at its boundary for a factor of their own, since
other parts of the reference may go on there. Factors are of at least ``window`` words by then, and become the spans that are removed.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null text has no words; rows without an id are compared with nothing and
keep all; rows that share an id count as one document. Extra columns are ignored; an empty table gives an empty result. Ids must be
integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import Kind, covered, repeated_spans, runs_of, sorted_rows, span_lists

WINDOW = 13
GRAM = 5


def greedy_factors(kind: Kind, block: np.ndarray, doc: np.ndarray, pos: np.ndarray, lhs: np.ndarray, rhs: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and intervals of factors: for each place the longest matches with earlier documents, from left to right."""
    n, before, least = len(block), kind.reach - 1, kind.length
    words = np.unique(cells, return_inverse=True)[1].reshape(cells.shape).astype(">u4")
    end = np.full(n, -(1 << 30), dtype=np.int64)  # where the factor of a place ends, counted from its anchor
    rows, starts, ends = [], [], []
    for j in range(before, -1, -1):
        here = np.ascontiguousarray(words[:, before - j :])
        order, common = sorted_rows(block, here.view(np.uint8).reshape(n, -1))
        common = np.where(common < 0, -1, common // 4)
        longest = np.zeros(n, dtype=np.int64)
        for size in range(least, least + j + 1):
            # the index at this depth: runs of places that agree in ``size`` words, with the first document of each
            run = np.flatnonzero(common < size)
            first = np.repeat(np.minimum.reduceat(doc[order], run), np.diff(np.append(run, n)))
            found = np.zeros(n, dtype=bool)
            found[order] = first < doc[order]
            # a match of ``size`` words may not reach over the ends of the text
            found &= (j <= lhs) & (size - j <= rhs)
            if not found.any():
                break
            longest[found] = size
        open_ = np.flatnonzero((longest > 0) & (least - j > end))
        rows.append(open_), starts.append(pos[open_] - j), ends.append(pos[open_] - j + longest[open_])
        end[open_] = longest[open_] - j
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (first word and the one after, of each run), kept_sha256."""
    kind = Kind("word", window, min(gram, window), own=False)

    def finish(batches):
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                texts = batch.column(1).cast(pa.large_binary()).to_pylist()
                n, removed, runs, digests = [], [], [], []
                for text, spans in zip(texts, span_lists(batch), strict=True):
                    words = (text or b"").split()
                    mask = covered(len(words), spans)
                    parts = runs_of(mask)
                    at, kept = 0, []
                    for a, b in parts:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    n.append(len(words)), removed.append(int(mask.sum())), runs.append([{"start": int(a), "end": int(b)} for a, b in parts])
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, kinds), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept_sha256"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return repeated_spans(kind, docs, greedy_factors, finish, "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string")
