"""Cross-tokenizer alignment: pointer jumping over the byte ranges of two tokenizations.

A space and the text is encoded by a byte-level BPE (A) and by a piece model that adds the space itself (B). Every token
points to its farthest-right overlapping token of the other side; doubling the pointers leads each to the terminal token of its
component, at a byte where tokens of both sides end. Components are the groups; the last tokens of both sides of a group
are linked. An id pair's count says how many links hold it in the whole corpus.

A text is cut before every space that follows a non-space character. Neither tokenizer has a token across such a cut: A's
pattern starts anew there, and no piece of B holds a space behind other characters (checked when it is loaded). Equal
pieces are encoded and aligned once while they are in a task's memo, which is bounded and starts anew when full.

The first pass stores numbers, digest and distinct links of each document, not its tokens. Links are added up in each task,
then by pair. The table of pairs, at most the product of two vocabularies, is broadcast in rounds of at most ``ROUND_PAIRS`` and the
sums of a document run on from round to round, so the hottest pair is joined with nothing. One round is enough for some
four million pairs.

Texts that are null, empty, or whose joined tokens differ from the space and the text (a U+2581 in it) have no tokens:
zeros and an empty string. Rows that repeat an id give rows of their own; null ids stay. Ids are cast to long. Extra columns
are ignored; an empty table gives no rows. The tokenizers' files are read by the driver and sent to the executors by Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, materialize, modest_batches, pack, release, signed, unpack
from .token_output import PATTERN

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
MEMO_PIECES = 300_000
ROUND_PAIRS = 4_000_000
#: Distinct pairs that a task adds up before it sends them on.
TASK_PAIRS = 1_000_000

UNEVEN = re.compile(r" \s|\s ")
CUT = re.compile(r"(?<=\S)(?= )")
#: Beyond Latin letters and punctuation the two libraries' classes of characters may be of other Unicode versions.
PLAIN = re.compile(r"[\x00-ɏ‐-‧]*")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the entries of a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A: ids of a byte-level BPE file, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols = byte_symbols()
        vocabulary = {bytes(symbols[c] for c in entry): i for entry, i in model["vocab"].items()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = entry
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        self.ranked = ids == sorted(ids) and len(set(ids)) == len(ids)  # then merging by rank is merging by id
        self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})._core_bpe.encode_ordinary if self.ranked else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        quick, plain = self.quick, PLAIN.fullmatch
        if quick is None:
            return [x.ids for x in self.exact.encode_batch_fast(texts, add_special_tokens=False)]
        out = [quick(t) if plain(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.exact.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out


class Pieces:
    """B: ids of a piece model that adds a space in front, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                raise ValueError("this model has pieces that hold a space behind other characters")
        self.space = model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids if t else [self.space] for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B, numbered from 0, by pointer jumping.

    Both arrays hold ascending ends of tokens that cover the same bytes without gaps.
    """
    n = len(a_ends)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last_b = np.searchsorted(b_ends, a_ends, side="left")  # the B token that holds the last byte
    last_a = np.searchsorted(a_ends, b_ends, side="left")
    terminal = b_ends[last_b] == a_ends
    to = np.concatenate((np.where(terminal, np.arange(n), n + last_b), last_a))
    while (jump := to[to]).tobytes() != to.tobytes():
        to = jump
    numbers = np.cumsum(terminal) - 1
    return numbers[to[:n]], numbers[to[n:]]


class Aligner:
    """Aligns texts piece by piece, with a bounded memo of pieces."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << 16:
            raise ValueError("ids of these tokenizers do not fit in 16 bits")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 3), dtype=np.int32)  # tokens of A, of B, links
        self.links = np.zeros(0, dtype=np.uint32)
        self.firsts = np.zeros(1, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encode and align new pieces; those that B does not give back get -1."""
        a_ids, b_ids = self.a.encode([" " + p for p in pieces]), self.b.encode(pieces)
        join, a_bytes, b_bytes, good = b"".join, self.a.bytes, self.b.bytes, []
        for p, x, y in zip(pieces, a_ids, b_ids, strict=True):
            if join([b_bytes[i] for i in y]) == join([a_bytes[i] for i in x]) == b" " + p.encode():
                self.index[p] = len(self.groups) + len(good)
                good.append((x, y))
            else:
                self.index[p] = -1
        if not good:
            return
        a, b = (np.array([i for g in good for i in g[k]], dtype=np.int64) for k in (0, 1))
        ga, gb = components(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))
        a_last, b_last = np.flatnonzero(np.diff(ga, append=-1)), np.flatnonzero(np.diff(gb, append=-1))
        links = (a[a_last] << 16 | b[b_last]).astype(np.uint32)
        n_a, n_b = (np.array([len(g[k]) for g in good]) for k in (0, 1))
        group_ends = ga[np.cumsum(n_a) - 1] + 1  # a piece ends a group
        sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        said, i, j = [], 0, 0
        for x, y in zip((a_last + 1).tolist(), (b_last + 1).tolist(), strict=True):
            said.append(f"{','.join(sa[i:x])}|{','.join(sb[j:y])}")
            i, j = x, y
        start = 0
        for end in group_ends.tolist():
            self.groups.append(";".join(said[start:end]))
            start = end
        n_links = np.diff(group_ends, prepend=0)
        self.numbers = np.concatenate((self.numbers, np.stack((n_a, n_b, n_links), axis=1).astype(np.int32)))
        self.firsts = np.concatenate((self.firsts, self.firsts[-1] + np.cumsum(n_links)))
        self.links = np.concatenate((self.links, links))

    def align(self, texts: list[str]):
        """Of each text: tokens of A, of B, groups, links (as a << 16 | b), and the groups as text."""
        if len(self.index) > MEMO_PIECES:
            self._forget()
        cut = [CUT.split(" " + t) if UNEVEN.search(" " + t) else None for t in texts]
        cut = [t.split(" ") if c is None else [p[1:] for p in c] for t, c in zip(texts, cut, strict=True)]
        if new := {p for c in cut for p in c}.difference(self.index):
            self._learn(list(new))
        find, say = self.index.__getitem__, self.groups.__getitem__
        for text, pieces in zip(texts, cut, strict=True):
            at = list(map(find, pieces)) if text else [-1]
            places = np.array(at, dtype=np.int64)
            if places.min() < 0:
                yield 0, 0, 0, self.links[:0], ""
                continue
            n_a, n_b, n_links = self.numbers[places].sum(axis=0, dtype=np.int64).tolist()
            counts = self.numbers[places, 2].astype(np.int64)
            steps = np.arange(n_links) - np.repeat(np.cumsum(counts) - counts, counts)
            yield n_a, n_b, n_links, self.links[np.repeat(self.firsts[places], counts) + steps], ";".join(map(say, at))


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B, keep_groups: bool = True) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups (or else their sha256 as bytes), packed (distinct links and how often each)."""
    modest_batches(docs.sparkSession)
    for path in (a, b):
        docs.sparkSession.sparkContext.addFile(path)
    names = os.path.basename(a), os.path.basename(b)
    kind = pa.string() if keep_groups else pa.binary()

    def run(batches):
        on = aligner(*map(SparkFiles.get, names))
        for batch, texts in groups(batches):
            numbers, said, packed = [], [], []
            for n_a, n_b, n, links, groups_ in on.align([t.decode("utf-8", "replace") for t in texts]):
                numbers.append((n_a, n_b, n))
                said.append(groups_ if keep_groups else hashlib.sha256(groups_.encode()).digest() if n else b"")
                keys, often = np.unique(links, return_counts=True)
                packed.append(pack(np.diff(keys, prepend=np.uint32(0)), often.astype(np.uint32)))
            table = np.array(numbers, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i]) for i in range(3)), pa.array(said, kind), pa.array(packed, pa.binary())], names=["doc_id", "n_a", "n_b", "n_groups", "groups", "packed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, groups {'string' if keep_groups else 'binary'}, packed binary")


def _links(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, often = unpack(packed, np.uint32, np.uint32)
    return np.cumsum(steps, dtype=np.uint32), often


def pair_counts(rows: DataFrame) -> DataFrame:
    """The linked id pairs of the whole table: pair (a << 16 | b), n."""

    def run(batches):
        have, counts, more, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def added():
            keys, at = np.unique(np.concatenate([have, *(k for k, _ in more)]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([counts, *(c for _, c in more)]), minlength=len(keys)).astype(np.int64)

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(have.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            for p in batch.column(0).to_pylist():
                more.append(_links(p))
                size += len(more[-1][0])
                if size > TASK_PAIRS:
                    (have, counts), more, size = added(), [], 0
                    if len(have) > TASK_PAIRS:
                        yield sent()
                        have, counts = have[:0], counts[:0]
        have, counts = added()
        yield sent()

    return rows.select("packed").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _with_sums(rows: DataFrame, held) -> DataFrame:
    """Adds what the broadcast pairs of this round give to n_best and count_sum."""
    schema = rows.schema
    last = len(schema) - 2

    def run(batches):
        keys, counts, best = held.value
        for batch in batches:
            sums = np.zeros((batch.num_rows, 2), dtype=np.int64)
            for i, p in enumerate(batch.column(batch.schema.get_field_index("packed")).to_pylist()):
                pairs, often = _links(p)
                if len(keys) and len(pairs):
                    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    there = keys[at] == pairs
                    at, often = at[there], often[there].astype(np.int64)
                    sums[i] = (often[best[at]].sum(), (often * counts[at]).sum())
            more = [pa.array(batch.column(last + k).to_numpy(zero_copy_only=False) + sums[:, k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *more], names=schema.names)

    return rows.mapInArrow(run, schema)


def align_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = TOKENIZER_A, b: str = TOKENIZER_B, keep_groups: bool = True, round_pairs: int = ROUND_PAIRS) -> DataFrame:
    """``aligned`` with the counts of the corpus: n_links, n_best (links that are the most frequent of their B id), count_sum."""
    spark = docs.sparkSession
    rows = materialize(aligned(docs, id_col, text_col, a, b, keep_groups), "aligned")
    counts = materialize(pair_counts(rows), "pair-counts")
    of_b = F.col("pair").bitwiseAND(0xFFFF)
    most = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # a row of a B id at most
    marked = counts.withColumn("b", of_b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    rounds = max(1, -(-counts.count() // round_pairs))
    at, before = F.pmod(F.xxhash64("pair"), F.lit(rounds)), None
    out = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for i in range(rounds):
        table = (marked.filter(at == i) if rounds > 1 else marked).toArrow().sort_by("pair")
        held = spark.sparkContext.broadcast((table.column("pair").to_numpy().astype(np.uint32), table.column("n").to_numpy(), table.column("best").to_numpy()))
        out = _with_sums(out, held)
        if i < rounds - 1:
            out = materialize(out, "aligned")
            release(rows if before is None else before)
            before = out
    release(counts)
    return out.withColumn("n_links", F.col("n_groups"))
