"""Token-ID / binary output: training-order materialisation in fixed-stride shards.

Every text is encoded with a public tokenizer, ended by one end token and cut into sequences of ``seq_len`` ids; the
last is padded with the end token. Sequences are numbered in order of (doc_id, place in the text); a keyed Feistel
permutation of [0, N) with cycle-walking gives each its global slot, so the training order is a pure function of the
key. A range partition by slot then lays slots into shards of ``shard_slots`` records of ``2 * seq_len`` bytes: the
record of slot s starts at byte ``(s % shard_slots) * stride`` of shard ``s // shard_slots``, so a reader resumes
anywhere with one seek.

Numbering is distributed: the documents' counts (no texts) are dealt by ranges of the ids that hold about equally many, whatever the ids are,
and stored with the number of their range; the running total of ranges has one row a partition, and a window runs within one
range only. The place of each document, two numbers, then meets its ids: broadcast while there are at most ``BROADCAST_DOCS`` documents, by a
shuffle join beyond. The ids are written once, compressed, to the shared folder. The tokenizer's file is read by the driver and sent to the executors
by Spark.

Null and empty texts give one sequence of end tokens. Rows that repeat an id get sequences of their own (numbered by
text among themselves); null ids come first. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, modest_batches, pack, parts, release, scratch_root, tidy, unpack

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQ_LEN = 512
SHARD_SLOTS = 4096
CACHE_ENTRIES = 500_000
BROADCAST_DOCS = 2_000_000
UNEVEN = re.compile(r" \s|\s ")


class Encoder:
    """Byte-level BPE ids as little-endian uint16, with a bounded memo of encoded pieces.

    A piece starts at every single space between two non-space characters, where the tokenizer's own pattern always
    starts a token; a text with other runs of spaces goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        if self.end >= 1 << 16:
            raise ValueError("ids of this tokenizer do not fit in 16 bits")
        self.call = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.memo: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        return array("H", self.call(text)).tobytes()

    def _add(self, piece: str) -> bytes:
        if not piece.isalpha() and piece[-1] in ".,;:!?" and piece[:-1].isalpha():  # a word and its mark are tokens apart
            ids = (self.memo.get(piece[:-1]) or self._add(piece[:-1])) + (self.marks.get(piece[-1]) or self.marks.setdefault(piece[-1], self._raw(piece[-1])))
        else:
            ids = self._raw(" " + piece)
        if len(self.memo) < CACHE_ENTRIES:
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if text[:1].isspace() or text[-1:].isspace() or UNEVEN.search(text):
            return self._raw(text)
        get, add = self.memo.get, self._add
        pieces = iter(text.split(" "))
        out = [self._raw(next(pieces))]
        for p in pieces:
            ids = get(p)
            out.append(add(p) if ids is None else ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Feistel:
    """A keyed permutation of [0, n): four rounds on an even number of bits, walking cycles until inside."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(4)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in self.keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << half) | right

    def slots(self, index: np.ndarray) -> np.ndarray:
        x = self._once(index.astype(np.uint64))
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out])
        return x.astype(np.int64)


def _encode(docs: DataFrame, path: str, seq_len: int) -> DataFrame:
    """doc_id, h (of the text), n_seqs, packed (the ids with the end token, compressed)."""
    cols = docs.select("doc_id", "h", "text")
    schema = cols.selectExpr("doc_id", "h", "0L AS n_seqs", "X'' AS packed").schema
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches):
        import zstandard

        enc = encoder(SparkFiles.get(name))
        end = array("H", [enc.end]).tobytes()
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [enc.encode(t or "") + end for t in part.column(2).to_pylist()]
                n = [-(-len(x) // (2 * seq_len)) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([pack(x) for x in ids], pa.binary())], names=schema.names)

    return cols.mapInArrow(run, schema)


def _dealt(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, seq_len: int, shard_slots: int, key: int) -> tuple[DataFrame, list[DataFrame]]:
    """slot, doc_id, seq_no, n_tokens, packed (the ids, compressed, without padding), shard: dealt by ranges of slots and sorted by slot inside each;
    and the stored tables that it reads."""
    modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = _encode(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), tokenizer, seq_len)
    coded = materialize(coded.withColumn("uid", F.monotonically_increasing_id()), "token-ids")  # written once, so uid and ids stay as they are
    counts = coded.select("uid", "doc_id", "h", "n_seqs")
    order = ("doc_id", "h", "uid")
    counts = materialize(counts.repartitionByRange(parts(spark), *order).withColumn("range", F.spark_partition_id()), "token-counts")
    total = counts.agg(F.sum("n_seqs")).first()[0]
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("range").agg(F.sum("n_seqs").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(running), F.lit(0))).select("range", "start")
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.join(F.broadcast(starts), "range")  # one row a partition
    numbered = numbered.select("uid", (F.col("start") + F.coalesce(F.sum("n_seqs").over(inside), F.lit(0))).alias("first"))
    numbered = materialize(numbered, "token-places")  # two numbers a document
    release(counts)
    few = F.broadcast(numbered) if numbered.count() <= BROADCAST_DOCS else numbered
    joined = coded.select("uid", "doc_id", "packed").join(few, "uid").select("doc_id", "first", "packed")
    n, stride = int(total or 0), 2 * seq_len

    def cut(batches):
        import zstandard

        order = Feistel(max(1, n), key)
        pack, unpack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids, nos, lens, index, records = [], [], [], [], []
                for doc_id, first, packed in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    tokens = unpack(packed)
                    for no, at in enumerate(range(0, len(tokens), stride)):
                        part = tokens[at : at + stride]
                        ids.append(doc_id), nos.append(no), lens.append(len(part) // 2), index.append(first + no), records.append(pack(part))
                slots = order.slots(np.array(index, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(lens, pa.int32()), pa.array(records, pa.binary())], names=["slot", "doc_id", "seq_no", "n_tokens", "packed"])

    cut_rows = joined.mapInArrow(cut, "slot long, doc_id long, seq_no int, n_tokens int, packed binary")
    cut_rows = cut_rows.withColumn("shard", F.floor(F.col("slot") / F.lit(shard_slots)).cast("long"))
    shards = max(1, -(-n // shard_slots))
    ranges = min(parts(spark), shards)
    # slots fill [0, N) evenly, so equal ranges need no sampling pass
    dealt = cut_rows.repartitionById(ranges, F.floor(F.col("shard") * F.lit(ranges) / F.lit(shards)).cast("int")).sortWithinPartitions("slot")
    return dealt, [coded, numbered]


def _end_token(tokenizer: str) -> bytes:
    """The end token as it stands in a record; it follows the ranks."""
    with open(tokenizer, "rb") as f:
        return array("H", [sum(1 for _ in f)]).tobytes()


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = 1) -> DataFrame:
    """One row per sequence, dealt out by ranges of slots and sorted by slot inside each: slot, shard, doc_id, seq_no, n_tokens, record.

    ``record`` holds ``n_tokens`` little-endian uint16 ids, padded with the end token to ``seq_len``.
    """
    dealt, _ = _dealt(docs, id_col, text_col, tokenizer, seq_len, shard_slots, key)
    end, stride = _end_token(tokenizer), 2 * seq_len

    def pad(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                records = [(raw := unpack(x)) + end * ((stride - len(raw)) // 2) for x in piece.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(5), piece.column(1), piece.column(2), piece.column(3), pa.array(records, pa.binary())], names=["slot", "shard", "doc_id", "seq_no", "n_tokens", "record"])

    return dealt.mapInArrow(pad, "slot long, shard long, doc_id long, seq_no int, n_tokens int, record binary")


def _whole_shards(dealt: DataFrame) -> DataFrame:
    """shard, rows (slots, ids, numbers, lengths), ids (the token ids of its sequences one after the other): a row a shard."""

    def run(batches):
        import zstandard

        unpack_, pack_ = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        now, held = None, []

        def done():
            slots, ids, known, nos, lens = (np.concatenate([h[i] for h in held]) for i in range(5))
            rows = pack(slots, ids, known, nos, lens)
            data = pack_(b"".join(b for h in held for b in h[5]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([rows], pa.binary()), pa.array([data], pa.binary())], names=["shard", "rows", "ids"])

        for batch in batches:
            shards = batch.column(5).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(shards, prepend=shards[:1] - 1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(shards)], strict=True):
                if int(shards[a]) != now:
                    if held:
                        yield done()
                    now = int(shards[a])
                part = batch.slice(a, b - a)
                ids = part.column(1)
                held.append((part.column(0).to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False), [unpack_(x) for x in part.column(4).to_pylist()]))
        if held:
            yield done()
        give_back()

    return dealt.mapInArrow(run, "shard long, rows binary, ids binary")


def _shards(batches, path: str):
    """Write the shards of a task; of each that is done: shard, file, its rows (slot, doc_id, seq_no, n_tokens), n_bytes, sha256.

    A file is written under a name of its own attempt and then renamed, so a retried or duplicated task leaves the
    same bytes.
    """
    import os
    import uuid

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    now = out = None

    def finish():
        out.close()
        store.move(f"{root}/{temp}", f"{root}/{name}")
        return now, name, rows, size, digest.hexdigest()

    for batch in batches:
        for slot, shard, doc_id, seq_no, n_tokens, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != now:
                if out:
                    yield finish()
                now, name = shard, f"shard-{shard:08d}.bin"
                temp = f".{name}.{os.getpid()}-{uuid.uuid4().hex}"
                out, digest, rows, size = store.open_output_stream(f"{root}/{temp}"), hashlib.sha256(), [], 0
            out.write(record)
            digest.update(record)
            rows.append((slot, doc_id, seq_no, n_tokens))
            size += len(record)
    if out:
        yield finish()


def write_shards(seqs: DataFrame, path: str, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Write each shard of ``sequences`` as one fixed-stride file under ``path`` (a URI that all executors reach).

    Returns shard, file, n_records, n_bytes, sha256.
    """

    def run(batches):
        done = [(shard, name, len(rows), size, digest) for shard, name, rows, size, digest in _shards(batches, path)]
        names = ["shard", "file", "n_records", "n_bytes", "sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=names)

    return seqs.mapInArrow(run, "shard long, file string, n_records long, n_bytes long, sha256 string")


def read_slots(path: str, first: int, count: int, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS):
    """Sequential, resumable read: the records of slots first .. first + count - 1, each as an array of ids."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    stride = 2 * seq_len
    while count > 0:
        at = first % shard_slots
        with store.open_input_file(f"{root}/shard-{first // shard_slots:08d}.bin") as f:
            f.seek(at * stride)
            data = f.read(min(count, shard_slots - at) * stride)
        for i in range(0, len(data), stride):
            yield np.frombuffer(data[i : i + stride], dtype="<u2")
        got = len(data) // stride
        if not got:
            return
        first, count = first + got, count - got


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = 1) -> DataFrame:
    """Write all shards and read them back: slot, shard, byte_offset, doc_id, seq_no, n_tokens, record_sha256 of each record.

    The files go to ``path``, or else to a fresh folder below that of ``spark.checkpoint.dir``, whenever the rows are
    computed; offsets and hashes are those of the bytes in the files. The sequences are stored once more in their order, a row a shard and without
    padding, so that the ids by document and what was shuffled are gone before the shards are written.
    """
    dealt, read = _dealt(docs, id_col, text_col, tokenizer, seq_len, shard_slots, key)
    whole = materialize(_whole_shards(dealt), "token-shards")
    del dealt  # what it shuffled goes with it
    release(*read)
    tidy(docs.sparkSession, rounds=3)
    path = path or f"{scratch_root(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}"
    end, stride = _end_token(tokenizer), 2 * seq_len

    def run(batches):
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for shard, rows, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                slots, docs_, known, nos, lens = unpack(rows.as_py(), np.int64, np.int64, np.uint8, np.int32, np.int32)
                data, ends = expand(ids.as_py()), 2 * np.cumsum(lens, dtype=np.int64)
                name = f"shard-{shard:08d}.bin"
                temp = f".{name}.{os.getpid()}-{uuid.uuid4().hex}"
                with store.open_output_stream(f"{root}/{temp}") as out:
                    for a, b in zip((ends - 2 * lens).tolist(), ends.tolist(), strict=True):
                        out.write(data[a:b] + end * ((stride - (b - a)) // 2))
                store.move(f"{root}/{temp}", f"{root}/{name}")
                with store.open_input_file(f"{root}/{name}") as f:
                    data = f.read()
                if len(data) != stride * len(slots):
                    raise OSError(f"{name} holds {len(data)} bytes, not {stride * len(slots)}")
                at = np.arange(len(slots), dtype=np.int64) * stride
                hashes = [hashlib.sha256(data[i : i + stride]).hexdigest() for i in at.tolist()]
                cols = [pa.array(slots), pa.array(np.full(len(slots), shard, dtype=np.int64)), pa.array(at), pa.array(docs_, mask=known == 0), pa.array(nos), pa.array(lens), pa.array(hashes, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "record_sha256"])

    return whole.mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, seq_no int, n_tokens int, record_sha256 string")
