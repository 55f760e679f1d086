"""Line dedup: documents probe a sharded minimal perfect hash over the repeated lines instead of joining lines.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code
points that are found in at least ``min_docs`` documents lose all their lines, except in the document of the largest
id that holds the key, which keeps all of its own.

Only 128-bit hashes of keys and ids are shuffled, counted in the map stage first; a key's lines are one row a task, so a
hot line is no hot task. The hashes of keys that are frequent enough are dealt into shards of about ``SHARD_KEYS``. In each a
minimal perfect hash of bit arrays by levels (a key takes the first level where no other key wants its bit; its number
is the rank of that bit) indexes three arrays: 64-bit fingerprint, count, id that keeps the line. The shards are broadcast
in rounds of at most ``ROUND_BYTES``; one round is enough up to some three million repeated lines, and each further round
reads the documents once more, so nothing is joined whatever the number of lines.

Null and empty texts have one empty line. Rows that repeat an id count as documents of their own, and all rows of the largest
id keep the line. Null ids are less than any other. Ids are cast to long. Extra columns are ignored; an empty table
gives no rows. A key that is not in the hash is taken for one of it with a chance of 2^-64 a line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, materialize, mix, modest_batches, release, signed

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 1 << 17
ROUND_BYTES = 64 << 20
#: Bits of a level for each key that is left.
GAMMA = 2
BLANK = b" \t\n\v\f\r"
NO_ID = -(1 << 63)

_U = np.uint64


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys (two arrays of uint64)."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @staticmethod
    def _places(high, low, level: int, size: int) -> np.ndarray:
        return mix(high ^ mix(low + _U(level * 0x9E3779B97F4A7C15 % (1 << 64)))) % _U(size)

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(high):
            size = -(-GAMMA * len(high) // 64) * 64
            at = cls._places(high, low, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size)[at] == 1
            level = np.zeros(size, dtype=bool)
            level[at[alone]] = True
            sizes.append(size)
            bits.append(level)
            high, low = high[~alone], low[~alone]
        words = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little").view(_U)
        counts = np.bitwise_count(words).astype(np.uint32)
        return cls(np.array(sizes, dtype=np.int64), words, np.cumsum(counts, dtype=np.uint32) - counts)

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each key, from 0 without gaps; -1 or any number for keys that are not in it."""
        out, left, base = np.full(len(high), -1, dtype=np.int64), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self._places(high[left], low[left], level, size) + _U(base)
            block, bit = at >> _U(6), at & _U(63)
            there = (self.words[block] >> bit) & _U(1) == 1
            block, bit = block[there], bit[there]
            out[left[there]] = self.ranks[block] + np.bitwise_count(self.words[block] & ((_U(1) << bit) - _U(1)))
            left, base = left[~there], base + size
        return out


class Shard:
    """A perfect hash with its arrays, and its form in bytes."""

    KINDS = (np.int64, _U, np.uint32, _U, np.uint32, np.int64)

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.index, self.prints, self.counts, self.keepers = index, prints, counts, keepers

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        index = PerfectHash.of(high, low)
        order = np.argsort(index.numbers(high, low))
        return cls(index, low[order], np.minimum(counts, (1 << 32) - 1).astype(np.uint32)[order], keepers[order])

    def to_bytes(self) -> bytes:
        arrays = (self.index.sizes, self.index.words, self.index.ranks, self.prints, self.counts, self.keepers)
        head = np.array([a.nbytes for a in arrays], dtype=np.int64)
        return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        at, arrays = 8 * len(cls.KINDS), []
        for size, kind in zip(np.frombuffer(data, np.int64, len(cls.KINDS)).tolist(), cls.KINDS, strict=True):
            arrays.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(PerfectHash(*arrays[:3]), *arrays[3:])

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each key in the arrays, or -1."""
        at = self.index.numbers(high, low)
        at[at >= 0] = np.where(self.prints[at[at >= 0]] == low[at >= 0], at[at >= 0], -1)
        return at


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, if it is long enough."""
    key = line.strip(BLANK)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()  # of bytes: A-Z only


def _hashes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per distinct key: high and low half of its hash, n (documents that hold it), keeper (the largest id of these)."""
    modest_batches(docs.sparkSession)

    def run(batches):
        for batch, texts in groups(batches):
            digests, owners = [], []
            for i, text in enumerate(texts):
                found = {xxhash.xxh3_128_digest(k) for line in text.split(b"\n") if (k := _key(line, min_chars)) is not None}
                digests += found
                owners += [i] * len(found)
            high, low = _hashes(digests)
            yield pa.RecordBatch.from_arrays([signed(high), signed(low), batch.column(0).take(pa.array(owners, pa.int32()))], names=["high", "low", "id"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "high long, low long, id long").groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))


def build_shards(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """A perfect hash over the keys of ``line_counts``: shard, n_bytes, data; and the number of shards."""
    shards = max(1, -(-counts.count() // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        high, low, n, keeper = (table.column(c).to_numpy() for c in ("high", "low", "n", "keeper"))
        data = Shard.of(high.view(_U), low.view(_U), n, keeper).to_bytes()
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["shard", "n_bytes", "data"])

    dealt = counts.withColumn("shard", F.pmod(F.col("high"), F.lit(shards)).cast("long"))
    return materialize(dealt.groupBy("shard").applyInArrow(build, "shard long, n_bytes long, data binary"), "line-shards"), shards


def _rounds(shards: DataFrame, limit: int) -> list[list[int]]:
    """The shards of each round; a row a shard comes to the driver, without its data."""
    rounds, size = [[]], 0
    for shard, n in sorted(shards.select("shard", "n_bytes").collect()):
        if rounds[-1] and size + n > limit:
            rounds.append([])
            size = 0
        rounds[-1].append(shard)
        size += n
    return rounds


def _probe(rows: DataFrame, held, shards: int, min_chars: int) -> DataFrame:
    """Adds to ``dropped`` (numbers of lines) what the broadcast shards of this round say."""

    def run(batches):
        here = {k: Shard.from_bytes(v) for k, v in held.value.items()}
        for batch, texts in groups(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            digests, owners, lines = [], [], []
            for i, text in enumerate(texts):
                for j, line in enumerate(text.split(b"\n")):
                    if (k := _key(line, min_chars)) is not None:
                        digests.append(xxhash.xxh3_128_digest(k)), owners.append(i), lines.append(j)
            high, low = _hashes(digests)
            owners, lines = np.array(owners, np.int64), np.array(lines, np.int64)
            shard = high.view(np.int64) % shards
            gone = np.zeros(len(high), dtype=bool)
            for k, table in here.items():
                mine = np.flatnonzero(shard == k)
                at = table.find(high[mine], low[mine])
                mine, at = mine[at >= 0], at[at >= 0]
                gone[mine] = table.keepers[at] != ids[owners[mine]]
            dropped = batch.column(2).to_pylist()
            for i, j in zip(owners[gone].tolist(), lines[gone].tolist(), strict=True):
                dropped[i].append(j)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dropped, pa.list_(pa.int32()))], names=["id", "text", "dropped"])

    return rows.mapInArrow(run, "id long, text string, dropped array<int>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, text (the lines that stay)."""
    spark = docs.sparkSession
    counts = materialize(line_counts(docs, id_col, text_col, min_chars).filter(F.col("n") >= min_docs), "line-counts")
    shards, n_shards = build_shards(counts, shard_keys)
    release(counts)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.array().cast("array<int>").alias("dropped"))
    rounds, before = _rounds(shards, round_bytes), None
    for i, now in enumerate(rounds):
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in shards.filter(F.col("shard").isin(now)).collect()} if now else {})
        rows = _probe(rows, held, n_shards, min_chars)
        if i < len(rounds) - 1:
            rows = materialize(rows, "line-round")
            release(*([before] if before is not None else []))
            before = rows
    release(shards)

    def keep(batches):
        for batch, texts in groups(batches):
            n, kept = [], []
            for text, dropped in zip(texts, batch.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                n.append(len(lines))
                gone = set(dropped)
                kept.append(b"\n".join([x for j, x in enumerate(lines) if j not in gone]) if gone else text)
            lost = pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lost, pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_lines", "n_dropped", "text"])

    out = rows.mapInArrow(keep, "id long, n_lines long, n_dropped long, text string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_lines", "n_dropped", "text")
