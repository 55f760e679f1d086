"""Repeated windows of whole texts, found exactly and without comparing documents in pairs.

A text is a sequence of symbols (bytes, or 64-bit word hashes). Wanted is every window of ``length`` symbols that also
starts earlier in the corpus. Rolling hashes of ``gram`` symbols are the triggers: the least one among the
``length - gram + 1`` of a window is its anchor, so equal windows have equal anchors at equal places, and about two
of ``length - gram + 2`` positions are anchors. The anchors cut a text into phrases of bounded length, and an anchor with its
surroundings is all the windows that hang on it.

1. ``_anchors``: a row per anchor: hash of the gram, hash of the surroundings, document, position. Where a task has met the same
   surroundings in an earlier place, the row is known to be repeated (``sure``) and takes no part in the search.
2. ``_first_seen``: rows dealt by the gram's hash and sorted by (gram, surroundings, document, position). A row whose whole
   surroundings occurred earlier is repeated as it stands. Where one gram has several surroundings, the first row of each
   needs a closer look; a gram with one surrounding needs none.
3. ``_compare``: those rows bring their symbols (cut from the text at hand) and are dealt by gram again. What is repeated among
   the rows of a gram is told by the operator: by corpus order (``byte_dedup``) or by greedy factors (``substring_dedup``).
4. The intervals meet their text and are merged.

Memory: a task holds a batch and, in step 3, the rows of one gram up to ``GROUP_ROWS``; a gram with more goes on as
one row a window to a Spark aggregation with map-side combining. Surroundings are equal when two 64-bit hashes are; windows of
such large grams when two are; all others are compared symbol by symbol. Nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, groups, materialize, mix, modest_batches, parts, RangeHash, signed, Words

GROUP_ROWS = 20_000
HELD_ANCHORS = 400_000
_U = np.uint64


@dataclass(frozen=True)
class Kind:
    """What a window is. ``own``: whether an earlier start in the same document counts."""

    unit: str
    length: int
    gram: int
    own: bool

    @property
    def reach(self) -> int:
        return self.length - self.gram + 1

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """64-bit symbols of all texts in a row, and the texts' bounds."""
        if self.unit == "word":
            words = Words(texts, lower=False)
            return words.hashes, words.bounds
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        return BYTE_CODES[np.frombuffer(b"".join(texts), dtype=np.uint8)], bounds


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def find_anchors(kind: Kind, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors in order of position: text number, place in the text, gram hash, surroundings hash."""
    starts, ends = bounds[:-1], bounds[1:]
    if len(symbols) < kind.length:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 2
    ranges = RangeHash(symbols)
    grams = ranges.grams(kind.gram)
    low = _U(0xFFFFFFFF)
    key = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))  # of equal hashes the last
    least = _sliding_min(key, kind.reach)
    long = ends - starts >= kind.length
    step = np.zeros(len(symbols) + 1, dtype=np.int32)
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - kind.length + 1, -1)
    inside = np.cumsum(step)[: len(least)] > 0
    at = (low - (least[inside] & low)).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    text = np.searchsorted(starts, at, side="right") - 1
    lo, hi = np.maximum(at - kind.reach + 1, starts[text]), np.minimum(at + kind.length, ends[text])
    around = mix(ranges.ranges(lo, hi) ^ mix(((at - lo).astype(np.uint64) << _U(32)) | (hi - at).astype(np.uint64)))
    return text, at - starts[text], grams[at], around


def _anchors(kind: Kind, docs: DataFrame) -> DataFrame:
    def reduced(held):
        """Rows sorted by gram and surroundings; all but the first of equal surroundings are sure to be repeated."""
        gram, around, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pos, doc, around, gram))
        gram, around, doc, pos = gram[order], around[order], doc[order], pos[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        sure = doc != doc[first]
        if kind.own:
            sure |= pos != pos[first]
        gram = np.where(sure, mix(around ^ mix(doc.view(np.uint64))), gram)  # a sure row may go anywhere
        return pa.RecordBatch.from_arrays([signed(gram), signed(around), pa.array(doc), pa.array(pos), pa.array(sure)], names=["gram", "around", "doc_id", "pos", "sure"])

    def run(batches):
        held, n = [], 0
        for batch, texts in groups(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            text, at, gram, around = find_anchors(kind, *kind.symbols(texts))
            held.append((gram, around, ids[text].astype(np.int64), at.astype(np.int32)))
            n += len(gram)
            if n >= HELD_ANCHORS:
                yield reduced(held)
                held, n = [], 0
        if held:
            yield reduced(held)

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, "gram long, around long, doc_id long, pos int, sure boolean")


def _columns(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]


def _first_seen(kind: Kind, rows: DataFrame) -> DataFrame:
    """gram null: all windows at the anchor are repeated; else the anchor needs a closer look."""

    def run(batches):
        held = None  # the last row's gram, surroundings and first row of those; whether the gram has several; rows that wait for a second
        for batch in batches:
            if not batch.num_rows:
                continue
            sure = batch.column(4)
            known = batch.filter(sure)
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(2), known.column(3), pa.nulls(known.num_rows, pa.int64())], names=["doc_id", "pos", "gram"])
                batch = batch.filter(pa.compute.invert(sure))
                if not batch.num_rows:
                    continue
            gram, around, doc, pos = _columns(batch, 4)
            ahead = held is not None
            if ahead:
                gram, around, doc, pos = (np.concatenate((np.array([h], dtype=x.dtype), x)) for h, x in zip(held[:4], (gram, around, doc, pos), strict=True))
            new_gram = np.ones(len(gram), dtype=bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new = new_gram.copy()
            new[1:] |= around[1:] != around[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = np.zeros(len(gram), dtype=bool)
            again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
            lead = (first == np.arange(len(gram))) if kind.own else (doc == doc[first])
            group = np.cumsum(new_gram) - 1
            several = np.bincount(group, weights=new) > 1
            if ahead:
                several[0] |= held[4]
                lead[0] = False
                again[0] = True
            repeated = ~lead & ~again
            look = lead & ~again
            wait = [held[5]] if ahead else []
            if ahead and not several[0] and group[-1] > 0:
                wait = []
            now = look & several[group]
            late = look & (group == group[-1]) & ~several[group]
            docs_out, pos_out = [doc[repeated], doc[now]], [pos[repeated], pos[now]]
            grams_out = [np.zeros(int(repeated.sum()), dtype=np.int64), gram[now]]
            if wait and several[0]:
                docs_out.append(wait[0][0]), pos_out.append(wait[0][1]), grams_out.append(np.full(len(wait[0][0]), gram[0]))
                wait = []
            if group[-1] > 0:
                wait = []
            waiting = (np.concatenate([w[0] for w in wait] + [doc[late]]), np.concatenate([w[1] for w in wait] + [pos[late]]))
            held = (gram[-1], around[-1], doc[first[-1]], pos[first[-1]], bool(several[-1]), waiting)
            grams_all = np.concatenate(grams_out)
            mask = np.zeros(len(grams_all), dtype=bool)
            mask[: len(grams_out[0])] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs_out)), pa.array(np.concatenate(pos_out)), pa.array(grams_all, mask=mask)], names=["doc_id", "pos", "gram"])

    return rows.repartition(parts(rows.sparkSession), "gram").sortWithinPartitions("gram", "around", "doc_id", "pos").mapInArrow(run, "doc_id long, pos int, gram long")


def _with_symbols(kind: Kind, joined: DataFrame) -> DataFrame:
    """The symbols around each anchor that needs a closer look, absent ones as zero, and how many there are on each side."""
    reach, length = kind.reach, kind.length

    def run(batches):
        for batch in batches:
            keep = batch.filter(pa.compute.is_valid(batch.column(2)))
            for part, texts in groups(iter([keep])):
                symbols, bounds = kind.symbols(texts)
                lists = part.column(2)
                counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                pos, gram = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1)
                text = np.repeat(np.arange(len(counts)), counts)
                start, end = bounds[:-1][text], bounds[1:][text]
                fits = pos + start < end  # an id that repeats with another text
                pos, text, start, end, gram = pos[fits], text[fits], start[fits], end[fits], gram.filter(pa.array(fits))
                ids = part.column(0).to_numpy(zero_copy_only=False)[text]
                padded = np.concatenate((np.zeros(reach, dtype=np.uint64), symbols, np.zeros(length, dtype=np.uint64)))
                for at in range(0, len(pos), 4096):
                    p, s, e = pos[at : at + 4096], start[at : at + 4096], end[at : at + 4096]
                    index = (p + s)[:, None] + np.arange(1 - reach, length)[None, :]
                    values = padded[index + reach]
                    values[(index < s[:, None]) | (index >= e[:, None])] = 0
                    cells = values if kind.unit == "word" else None
                    if cells is None:  # bytes travel as bytes; 0xFF never occurs in UTF-8
                        cells = _BYTE_OF[np.searchsorted(_SORTED_CODES, values)].astype(np.uint8)
                        cells[values == 0] = 0xFF
                    width = cells.shape[1] * cells.itemsize
                    blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(cells), [None, pa.py_buffer(np.ascontiguousarray(cells).tobytes())]).cast(pa.binary())
                    left, right = np.minimum(p, reach - 1), np.minimum(e - s - p, length)
                    yield pa.RecordBatch.from_arrays([gram.slice(at, len(p)), pa.array(ids[at : at + 4096], pa.int64()), pa.array(p.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), blob], names=["gram", "doc_id", "pos", "lhs", "rhs", "cells"])

    return joined.mapInArrow(run, "gram long, doc_id long, pos int, lhs int, rhs int, cells binary")


_SORTED_CODES = np.concatenate(([_U(0)], np.sort(BYTE_CODES)))
_BYTE_OF = np.concatenate(([0], np.argsort(BYTE_CODES)))


def _window_hashes(kind: Kind, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, start and hash (with gram and place) of every whole window of the rows, by place and then row."""
    gram, doc, pos, lhs, rhs = _columns(batch, 5)
    width = kind.reach + kind.length - 1
    raw = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint64 if kind.unit == "word" else np.uint8)
    symbols = raw if kind.unit == "word" else BYTE_CODES[raw]
    grid = RangeHash(symbols)
    row0 = np.arange(len(gram), dtype=np.int64) * width
    rows, starts, keys = [], [], []
    salt = mix(gram.view(np.uint64))
    for j in range(kind.reach):
        off = kind.reach - 1 - j
        whole = np.flatnonzero((off <= lhs) & (kind.length - off <= rhs))
        at = row0[whole] + j
        rows.append(whole), starts.append(pos[whole] - off)
        keys.append(mix(grid.ranges(at, at + kind.length) ^ salt[whole] ^ _U(j)))
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(keys)


def _compare(kind: Kind, rows: DataFrame, judge: Callable) -> DataFrame:
    """Intervals [a, b) that are repeated (key null), or windows (a: start, gram, key) of grams with too many rows for one task's memory."""

    def settle(batch: pa.RecordBatch):
        gram, doc, pos, lhs, rhs = _columns(batch, 5)
        raw = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint64 if kind.unit == "word" else np.uint8)
        rows, start, end = judge(kind, gram, doc, pos.astype(np.int64), lhs, rhs, raw.reshape(len(gram), kind.reach + kind.length - 1))
        return out(doc[rows], start, end, None, None)

    def out(doc, a, b, gram, key):
        grams, keys = (pa.nulls(len(doc), pa.int64()),) * 2 if key is None else (pa.array(gram), signed(key))
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), grams, keys], names=["doc_id", "a", "b", "gram", "key"])

    def windows(batch):
        doc = batch.column(1).to_numpy(zero_copy_only=False)
        row, start, key = _window_hashes(kind, batch)
        return out(doc[row], start, start + kind.length, batch.column(0).to_numpy(zero_copy_only=False)[row], key)

    def run(batches):
        held, many = None, None  # rows of the gram at the end of the last batch; a gram that has too many
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            gram = batch.column(0).to_numpy(zero_copy_only=False)
            if many is not None:
                n = int(np.searchsorted(gram != many, True)) if (gram != many).any() else len(gram)
                if n:
                    yield windows(batch.slice(0, n))
                if n == len(gram):
                    continue
                batch, gram, many = batch.slice(n), gram[n:], None
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                gram = batch.column(0).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if (gram != gram[-1]).any() else 0
            if last:
                yield settle(batch.slice(0, last))
            held = batch.slice(last)
            if held.num_rows > GROUP_ROWS:
                many = gram[-1]
                for i in range(0, held.num_rows, 4096):
                    yield windows(held.slice(i, 4096))
                held = None
        if held is not None:
            yield settle(held)

    return rows.repartition(parts(rows.sparkSession), "gram").sortWithinPartitions("gram", "doc_id", "pos").mapInArrow(run, "doc_id long, a int, b int, gram long, key long")


def repeated_spans(kind: Kind, docs: DataFrame, judge: Callable, finish: Callable, schema: str) -> DataFrame:
    """``docs``: doc_id, text. ``finish(batches)`` gets doc_id, text and the list of repeated intervals (a, b); may reach over the end.

    ``judge(kind, gram, doc, pos, lhs, rhs, cells)`` gets whole grams, rows in order of gram, document and position, with ``lhs`` symbols of the
    text before and ``rhs`` from the anchor on, and gives the rows and intervals that occur earlier. Rows that share an id count as one
    document; rows without an id are left out of the search.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialize(_first_seen(kind, _anchors(kind, docs)), "anchors")
    looks = seen.filter("gram IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "gram")).alias("looks"))
    compared = materialize(_compare(kind, _with_symbols(kind, docs.join(looks, "doc_id", "left").select("doc_id", "text", "looks")), judge), "windows")
    reach, length = kind.reach, kind.length
    whole = seen.filter("gram IS NULL").select("doc_id", F.greatest(F.lit(0), F.col("pos") - (reach - 1)).alias("a"), (F.col("pos") + length).alias("b"))
    # grams with too many rows: the first start of each window by a Spark aggregation
    many = compared.filter("key IS NOT NULL").select("gram", "key", "doc_id", "a", "b")
    firsts = many.groupBy("gram", "key").agg(F.min(F.struct("doc_id", "a")).alias("first"))
    later = (F.col("doc_id") != F.col("first.doc_id")) | (F.lit(kind.own) & (F.col("a") != F.col("first.a")))
    more = many.join(firsts, ["gram", "key"]).filter(later).select("doc_id", "a", "b")
    spans = compared.filter("key IS NULL").select("doc_id", "a", "b").unionAll(whole).unionAll(more)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(finish, schema)


def sorted_rows(groups_: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and then by their bytes, and with how many bytes each row agrees with the one before (-1: another group)."""
    group = np.cumsum(np.diff(groups_, prepend=groups_[:1]) != 0).astype(">u4")  # the rows come with groups together
    whole = np.concatenate((group.view(np.uint8).reshape(len(group), 4), cells), axis=1)
    order = np.argsort(np.ascontiguousarray(whole).view(f"S{whole.shape[1]}").ravel(), kind="stable")
    here = whole[order]
    differ = here[1:] != here[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), whole.shape[1]) - 4
    return order, np.concatenate(([-1], np.where(common < 0, -1, common)))


def covered(n: int, spans: list | None) -> np.ndarray:
    """Mask of the symbols that the intervals cover."""
    step = np.zeros(n + 1, dtype=np.int32)
    if spans is not None and len(spans):
        np.add.at(step, np.minimum(spans[:, 0], n), 1)
        np.add.at(step, np.minimum(spans[:, 1], n), -1)
    return np.cumsum(step)[:n] > 0


def runs_of(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of a mask as rows (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def span_lists(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    lists = batch.column(2)
    flat = lists.flatten()
    both = np.stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)], axis=1) if len(flat) else np.zeros((0, 2), dtype=np.int32)
    counts = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    ends = np.cumsum(counts)
    return [both[e - c : e] for c, e in zip(counts, ends, strict=True)]
