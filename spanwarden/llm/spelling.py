"""Spelling variants: words one edit apart, found by Gram matrices of letter counts over blocks of words.

Words are the distinct runs of letters of all texts after a keyed deletion (see ``observed_words``), of at least ``min_chars``
code points and ``min_count`` occurrences. Two words are near if one inserted, deleted or replaced code point turns one
into the other. A word's form is its most frequent near word if that is ``ratio`` times as frequent; its root is where its
forms end.

Words of a length L and of L + 1 make a block, cut further by half a word: an edit leaves the first or the last L // 2 letters
as they are, so near words share one of these halves. A half that more than ``group_words`` words share is cut again at half
of what is left between its ends, for the same reason, until the groups are small or a single letter is left, so no group grows with
the corpus. Within a task consecutive groups are laid into one matrix of letter counts; its products with itself give all
squared distances, of which those of at most two are kept: an edit changes two counts by one at most (letters are folded to
``FOLD`` counts, which makes distances smaller only). Their edits are verified letter by letter. A pair that shares both halves is
taken by the first one.

What is shuffled is words with their counts: added up in each task before, four rows a word for the blocks, then one row for each near word
and block of counts and best forms, so a word that everybody writes is no hot key. Roots follow by doubling.

Null texts have no words; null ids count as empty in the key of the deletion; rows that repeat an id count each. Words have no upper bound of
length. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, materialize, modest_batches, parts, release

MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
EVERY = 31
FOLD = 32
#: Words that share a half before it is cut again.
GROUP_WORDS = 2048
#: Rows of a matrix, at least; a group is never split.
ROWS = 768
TASK_WORDS = 300_000
ALWAYS = 1 << 30
MANY_KEYS = 1_000_000


def observed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, min_chars: int = MIN_CHARS) -> DataFrame:
    """word, n: how often each run of letters occurs, after the keyed deletion.

    Runs are maximal, of ``[A-Za-z\\u00C0-\\u00FF]``, with A-Z lower-cased. Let h be the crc32 of ``<id>:<run>``: if ``every``
    divides it, the run loses its code point h % length. Results below ``min_chars`` are left out.
    """
    modest_batches(docs.sparkSession)
    run_of = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")  # a greedy match is a whole run; shorter ones never get longer

    def run(batches):
        crc, total = zlib.crc32, Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch, texts in groups(batches):
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                start, found = crc(f"{key}:".encode()), Counter(run_of.findall(text.lower().decode("utf-8", "replace")))
                for word in list(found):
                    h = crc(word.encode(), start)
                    if h % every == 0:
                        n, at = found.pop(word), h % len(word)
                        if len(word) > min_chars:
                            total[word[:at] + word[at + 1 :]] += n
                total.update(found)
            if len(total) > TASK_WORDS:
                yield sent()
                total.clear()
        yield sent()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _half_keys(words: DataFrame) -> DataFrame:
    """Four rows a word: block (the shorter length), path (of cuts), p and s (letters shared at both ends), before, key, word, n."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("block"))
    rows = rows.select("word", "n", "block", F.floor(F.col("block") / 2).cast("int").alias("half"))
    return _keyed(rows.select("word", "n", "block", F.explode(F.array(
        F.struct(F.lit("l").alias("path"), F.col("half").alias("p"), F.lit(0).alias("s"), F.lit(ALWAYS).alias("before")),
        F.struct(F.lit("r").alias("path"), F.lit(0).alias("p"), F.col("half").alias("s"), F.col("half").alias("before")),
    )).alias("c")).select("word", "n", "block", "c.*"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The group of a row: the cuts that led to it (two ways may share the same ends) and its ends. ``before``: only pairs that first differ
    before this letter count here."""
    ends = F.concat(F.col("word").substr(F.lit(1), F.col("p")), F.lit("|"), F.col("word").substr(F.length("word") - F.col("s") + 1, F.col("s")))
    return rows.withColumn("key", F.concat_ws("|", F.col("block").cast("string"), "path", ends))


def _cut_again(rows: DataFrame) -> DataFrame:
    """Each row twice, sharing half of what is left between its ends at the left or at the right."""
    more = F.floor((F.col("block") - F.col("p") - F.col("s")) / 2).cast("int")
    left = F.struct(F.concat("path", F.lit("l")).alias("path"), (F.col("p") + more).alias("p"), F.col("s").alias("s"), F.col("before").alias("before"))
    right = F.struct(F.concat("path", F.lit("r")).alias("path"), F.col("p").alias("p"), (F.col("s") + more).alias("s"), F.least(F.col("before"), F.col("p") + more).alias("before"))
    return _keyed(rows.select("word", "n", "block", F.explode(F.array(left, right)).alias("c")).select("word", "n", "block", "c.*"))


def blocks(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """The rows of all groups, none of which has more than ``group_words`` words if it can be cut."""
    rows, done = materialize(_half_keys(words), "halves"), None
    while True:
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.first(F.col("block") - F.col("p") - F.col("s")).alias("left"))
        large = materialize(large.filter((F.col("size") > group_words) & (F.col("left") > 1)).select("key"), "large")
        n = large.count()
        few = F.broadcast(large) if n <= MANY_KEYS else large
        small = rows.join(few, "key", "left_anti") if n else rows
        done = small if done is None else done.unionByName(small)
        if not n:
            return done
        rows = materialize(_cut_again(rows.join(few, "key", "left_semi")), "halves")


class _Words:
    """Some words of similar lengths as a matrix of latin-1 letters, their lengths and folded letter counts."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        width = int(self.sizes.max()) + 1
        self.letters = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(len(words), width)
        row, column = np.nonzero(self.letters)
        cell = row * FOLD + self.letters[row, column] % FOLD
        self.counts = np.bincount(cell, minlength=len(words) * FOLD).reshape(-1, FOLD).astype(np.float32)
        self.squares = (self.counts * self.counts).sum(axis=1)


def first_difference(w: _Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where the words i and j first differ if they are one edit apart, else -1; i is the shorter or as long."""
    a, b = w.letters[i], w.letters[j]
    differ = a != b
    first = differ.argmax(axis=1)
    same = w.sizes[i] == w.sizes[j]
    one = differ.sum(axis=1) == 1
    shifted = a[:, :-1] != b[:, 1:]
    behind = ~(shifted & (np.arange(shifted.shape[1]) >= first[:, None])).any(axis=1)
    return np.where(np.where(same, one, behind & (w.sizes[j] == w.sizes[i] + 1)), first, -1)


def near_pairs(words: list[bytes], groups_: np.ndarray, blocks_: np.ndarray, before: np.ndarray, tile: int = 1024):
    """Pairs (shorter or first, other) of near words within a group; rows of a group are together."""
    w = _Words(words)
    n = len(words)
    last = np.searchsorted(groups_, groups_, side="right")  # the end of each row's group
    found = []
    for top in range(0, n, tile):
        rows = slice(top, min(n, top + tile))
        for side in range(top, int(last[rows.stop - 1]), tile):
            columns = slice(side, min(n, side + tile))
            distance = w.squares[rows, None] + w.squares[None, columns] - 2 * (w.counts[rows] @ w.counts[columns].T)
            i, j = np.nonzero(distance <= 2)
            i, j = i + top, j + side
            keep = (groups_[i] == groups_[j]) & (i < j)
            i, j = i[keep], j[keep]
            swap = w.sizes[i] > w.sizes[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            keep = w.sizes[i] == blocks_[i]  # two of the longer ones meet in the next block
            i, j = i[keep], j[keep]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                first = first_difference(w, x, y)
                good = (first >= 0) & (first < before[x])
                found.append((x[good], y[good]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _near(batches):
    """Rows sorted by block and group: for each word of a matrix that has near words: word, n_near, form, form_n (the best of these)."""
    held: list[tuple] = []

    def solve(rows: list[tuple]):
        if not rows:
            return
        words = [r[1].encode("latin-1") for r in rows]
        keys = [r[0] for r in rows]
        group = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:], strict=False))])
        block, before, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 4, 2))
        i, j = near_pairs(words, group, block, before)
        if not len(i):
            return
        word, other = np.concatenate((i, j)), np.concatenate((j, i))
        ranks = np.empty(len(rows), dtype=np.int64)  # of words, in code-point order
        ranks[sorted(range(len(rows)), key=words.__getitem__)] = np.arange(len(rows))
        order = np.lexsort((ranks[other], -n[other], word))
        word, other = word[order], other[order]
        start = np.flatnonzero(np.diff(word, prepend=-1))
        many = np.diff(start, append=len(word))
        w, o = word[start].tolist(), other[start]
        yield pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k in w], pa.string()), pa.array(many.astype(np.int64)), pa.array([rows[k][1] for k in o.tolist()], pa.string()), pa.array(n[o])], names=["word", "n_near", "form", "form_n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[-1][0] and (len(held) >= ROWS or row[3] > 2 * held[0][3] + 16):
                yield from solve(held)
                held = []
            held.append(row)
    yield from solve(held)


def roots(forms: DataFrame) -> DataFrame:
    """word, form: word, root, where no word comes back to itself (each form is more frequent)."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialize(now.join(after, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        release(now)
        now = step
        if not step.filter("moved").limit(1).count():
            return step.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = EVERY, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    spark = docs.sparkSession
    words = materialize(observed_words(docs, id_col, text_col, every, min_chars).filter(F.col("n") >= min_count), "words")
    rows = blocks(words, group_words).select("key", "word", "n", F.col("block").cast("long").alias("block"), F.col("before").cast("long").alias("before"))
    rows = rows.repartition(parts(spark), "key").sortWithinPartitions("block", "key")
    near = rows.mapInArrow(_near, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    out = words.join(near, "word", "left")
    far = -F.col("best.n") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.n")).alias("form_n"))
    out = materialize(out, "forms")
    ends = roots(out.filter(F.col("form").isNotNull()))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
