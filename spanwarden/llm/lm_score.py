"""LM scoring with a hierarchical Pitman-Yor model whose seats are sampled by Gibbs.

One restaurant for each context, the word before; all of them share one parent, the restaurant of words, whose base is
uniform over the known words and one outcome for all others. A table of a context's restaurant is a customer of the parent.

* Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token a text; the end token is also the context
  of a text's first word. Words are told apart by 64-bit hashes, pairs by a hash of both.
* Counting covers all training rows: tasks pre-aggregate, words and pairs travel in packed pieces, pairs dealt by context. Contexts that make up more than
  one in ``HOT`` tokens (at most ``HOT`` of them) are dealt by pair instead, so that no task gets one of them whole.
* A pair seen once has one table whatever is drawn, so only pairs seen more often have seats. They lie in packed groups of about ``GROUP_TOKENS``
  tokens by their word and stay there; a sweep shuffles the groups' sums by context and word, and what the parent and the contexts answer, in packed pieces.
* A Gibbs sweep removes all customers of a dish from a restaurant, and its tables from the parent, and reseats them together: the number
  of their tables is drawn from its law given all else, generalised Stirling numbers times the weights of new tables (theta + d T) p, p
  growing as the dish's tables join the parent. Up to ``EXACT`` customers the draw is direct; beyond it takes ``STEPS`` steps of
  Metropolis on the same law. Dishes are reseated in parallel: the tables of other dishes are those of the last sweep, and
  customers that a dish sends to the parent join old tables there until the parent is reseated. Each sweep's tables are the
  parent's customers.
* The first sweep starts from the square roots of the counts, which is nearer to the law than one table each. ``BURN_IN`` sweeps
  are dropped; predictive probabilities are averaged over the others.
* Texts are tokenised once: each task writes what it reads as chunks of about ``CHUNK_BYTES`` of text, a row each with a number of its own (drawn, so
  that no two tasks share one), its sorted distinct words and the place of each token among them. Counting and scoring read these rows.
* Scoring: a chunk asks once for its distinct words and pairs; the sorted lists of questions and answers meet the chunk again by its number, and
  must be as many as it asked for. Chunks meet their answers in ``TURNS`` turns by their numbers, so that only a part of both is shuffled at a time.

``score`` is the log10 probability of the text by the model, over the outcomes of the base score: the known words and one
for all unknown ones. ``perplexity`` is 10 to the power of minus the mean score of a token. base_score = sum over tokens of
log10((c + 0.1) / (N + 0.1 (V + 1))).

Null texts count as empty (one end token); rows without an id are held out by no rule and learned from; rows that repeat
are scored each on its own and all learned from; extra columns are ignored; an empty training set leaves the uniform base; an
empty table gives an empty result. Ids must be integers. A task holds the hashed words of one chunk, or one text where that is longer.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back, groups, materialize, materialize_by, mix, modest_batches, pack, parts, release, tidy, unpack

SWEEPS = 3
BURN_IN = 1
DRAWN_ROWS = 150_000
STRENGTH = 1.0
HOT = 1 << 16
EXACT = 1024
STEPS = 12
FLUSH_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
GROUP_TOKENS = 4_000_000
CHUNK_BYTES = 8 << 20
TURNS = 2
END = np.uint64(0x5EED_0F_7E47)
_U = np.uint64

Weight = Callable[[np.ndarray, np.ndarray], np.ndarray]


# --- seats of one restaurant's dishes -------------------------------------------------------------------------------------


def _draw(key: np.ndarray, turn: np.ndarray | int) -> np.ndarray:
    """A number in [0, 1) for each key and turn: the same whichever task or attempt draws it."""
    return (mix(key ^ mix(np.atleast_1d(np.asarray(turn, dtype=np.uint64)))) >> _U(11)) * 2.0**-53


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    y = x + 8.0
    low = x * (x + 1) * (x + 2) * (x + 3)
    high = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low) - np.log(high)


class Stirling:
    """Logarithms of generalised Stirling numbers S(c, t): the number of ways, weighted by a discount d, to seat c customers at t tables.

    Up to ``EXACT`` customers by S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t); beyond, the saddle point of their generating function
    ((1 - (1 - z)^d) / d)^t / t!, with its error at ``EXACT`` customers (which depends on t alone as c grows) taken off.
    """

    def __init__(self, d: float):
        self.d = d
        self.table = np.full((EXACT + 1, EXACT + 2), -np.inf)
        self.table[1, 1] = 0.0
        t = np.arange(1, EXACT + 1)
        for c in range(1, EXACT):
            row = self.table[c]
            stay = row[1 : c + 1] + np.log(c - d * t[:c])
            self.table[c + 1, 1 : c + 2] = np.logaddexp(np.append(stay, -np.inf), row[: c + 1])
        few = np.arange(1, 257)
        self.error = np.concatenate(([0.0], self.table[EXACT, 1:257] - self._saddle(np.full(256, float(EXACT)), few)))

    def _saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        d, want = self.d, c / t
        low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)  # bounds of ln(1 - z)
        for _ in range(60):
            ln_y = (low + high) / 2
            z = -np.expm1(ln_y)
            over = d * z * np.exp((d - 1) * ln_y) / -np.expm1(d * ln_y) > want
            low, high = np.where(over, ln_y, low), np.where(over, high, ln_y)
        ln_y = (low + high) / 2
        z, rest = -np.expm1(ln_y), -np.expm1(d * ln_y)
        slope = 1 + (1 - d) * z * np.exp(-ln_y) - d * z * np.exp((d - 1) * ln_y) / rest
        return _ln_gamma(c + 1) - _ln_gamma(t + 1.0) + t * np.log(rest / d) - c * np.log(z) - 0.5 * np.log(2 * np.pi * c * slope)

    def beyond(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self._saddle(c.astype(np.float64), t.astype(np.float64)) + self.error[np.minimum(t, 256).astype(np.int64)]


@lru_cache(maxsize=4)
def stirling(d: float) -> Stirling:
    return Stirling(d)


def draw_tables(count: np.ndarray, t: np.ndarray, weight: Weight, log_new: Weight, d: float, key: np.ndarray, seed: int, fresh: bool) -> np.ndarray:
    """All customers of each dish leave and are reseated: a number of tables from its law given all else.

    The law of t is S(count, t) exp(log_new(dish, t)), ``log_new`` being the logarithm of the product of the weights of the dish's tables from
    the second to the t-th and ``weight(dish, t)`` that of the t-th alone. Up to ``EXACT`` customers it is drawn outright; beyond, by ``STEPS`` steps of Metropolis of the law's own width, from the last number of
    tables or (``fresh``) from the law's mode.
    """
    numbers, out = stirling(d), np.minimum(count, 1).astype(np.float64)
    turn = seed << 32
    width, below = 2, 1
    while below < EXACT:
        at = np.flatnonzero((count > below) & (count <= width))
        tables = np.arange(1, width + 1)
        for i in range(0, len(at), max(1, (1 << 18) // width)):
            some = at[i : i + max(1, (1 << 18) // width)]
            log = numbers.table[count[some].astype(np.int64), 1 : width + 1].copy()
            if width <= 64:
                log[:, 1:] += np.cumsum(np.log(weight(some[:, None], tables[None, 1:])), axis=1)
            else:
                log += log_new(some[:, None], tables[None, :].astype(np.float64))
            law = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            out[some] = 1 + (law < (_draw(key[some], turn) * law[:, -1])[:, None]).sum(axis=1)
        width, below = 2 * width, width
    at = np.flatnonzero(count > EXACT)
    if len(at):
        c = count[at].astype(np.float64)
        log = lambda k: numbers.beyond(c, k) + log_new(at, k)
        low, high = np.ones(len(at)), c - 1
        while (high > low).any():  # the mode: the law has one
            middle = np.floor((low + high) / 2)
            up = log(middle + 1) > log(middle)
            low, high = np.where(up & (low < high), np.minimum(middle + 1, high), low), np.where(up | (low >= high), high, middle)
        step = np.maximum(1.0, np.sqrt(low) / 8)
        bend = (2 * log(np.clip(low, 1 + step, c - 1 - step)) - log(np.clip(low, 1 + step, c - 1 - step) - step) - log(np.clip(low, 1 + step, c - 1 - step) + step)) / step**2
        wide = 2.4 / np.sqrt(np.maximum(bend, 1 / np.maximum(low, 1.0) / 4))
        now = low if fresh else np.clip(t[at], 1, c - 1)
        have = log(now)
        for i in range(1, STEPS + 1):
            leap = np.rint((_draw(key[at], turn + 3 * i) + _draw(key[at], turn + 3 * i + 1) - 1) * 2.45 * wide)
            to = now + leap
            inside = (to >= 1) & (to <= c - 1)
            new = log(np.clip(to, 1, c - 1))
            take = inside & (np.log(np.maximum(_draw(key[at], turn + 3 * i + 2), 1e-300)) < new - have)
            now, have = np.where(take, to, now), np.where(take, new, have)
        out[at] = now
    return out


def _rising(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln(start (start + 1) ... (start + n - 1))."""
    return _ln_gamma(start + n) - _ln_gamma(start)


# --- tokens, keys and packed lists -----------------------------------------------------------------------------------------


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in a row, an end token after each text; and where each text ends."""
    words = Words(texts, lower=True)
    return np.insert(words.hashes, words.bounds[1:], END), words.bounds[1:] + np.arange(1, len(texts) + 1)


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(word ^ mix(context + _U(0x9E37)))


def _steps(keys: np.ndarray) -> np.ndarray:
    """The steps of sorted hashes, first bytes first: those of the high bytes, which are zeros, pack to nothing."""
    return np.ascontiguousarray(np.diff(keys, prepend=_U(0)).reshape(-1, 1).view(np.uint8).T)


def _keys(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(steps.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    """The stable order by bucket; numbers of 16 bits are sorted by their digits, which is much faster."""
    return np.argsort(bucket.astype(np.uint16) if bucket.size and bucket.max() < 1 << 16 else bucket, kind="stable")


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order))
    return out


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    out = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values as they come, and the place of each value among them: by a hash table, without a sort."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(_firsts(keys))
    return keys[start], np.add.reduceat(values[order], start) if len(start) else values


def _home(words: np.ndarray, groups: int) -> np.ndarray:
    """The group that holds a word's state: as a dish of the parent, and as a context."""
    return (mix(words) % _U(groups)).astype(np.int32)


def _pair_bucket(context: np.ndarray, key: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, context), max(0, len(hot) - 1))
    is_hot = hot[at] == context if len(hot) else np.zeros(len(context), dtype=bool)
    return (np.where(is_hot, key, mix(context)) % _U(buckets)).astype(np.int32)


def _pieces(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of equal values of a sorted array."""
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), *([len(bucket)] if len(bucket) else [])], strict=True):
        yield int(bucket[a]), slice(a, b)


def _dealt(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays cut by bucket, in their order."""
    order = _by_bucket(bucket)
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    for b, s in _pieces(bucket):
        yield b, [a[s] for a in arrays]


def _chunks(rows: DataFrame) -> DataFrame:
    """doc_id, held_out, text as rows of whole chunks: chunk, n (tokens to learn from), words (sorted), docs (ids, flags, numbers of tokens, places of the tokens)."""

    def run(batches):
        held, size = [], 0

        def flush():
            ids, flags, counts, tokens = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            words, at = _distinct(tokens)
            order = np.argsort(words)
            words, at = words[order], _inverse(order)[at]
            docs = pack(ids, flags, counts, (at & 0xFFFF).astype(np.uint16), (at >> 16).astype(np.uint16))
            name, n = uuid.uuid4().int >> 65, int(counts[flags & 1 == 0].sum())
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([n], pa.int64()), pa.array([pack(_steps(words))], pa.binary()), pa.array([docs], pa.binary())], names=["chunk", "n", "words", "docs"])

        for part, texts in groups(batches):
            tokens, ends = _tokens(texts)
            ids, out = part.column(0), part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            flags = out | ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 1
            held.append((ids.fill_null(0).to_numpy(), flags, np.diff(ends, prepend=0), tokens))
            size += sum(map(len, texts))
            if size >= CHUNK_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "chunk long, n long, words binary, docs binary")


class _Docs:
    """A chunk as it is stored: tokens in a row, and for each document id (or None), held_out and number of tokens."""

    def __init__(self, words: bytes, docs: bytes):
        ids, flags, self.counts, low, high = unpack(docs, np.int64, np.uint8, np.int64, np.uint16, np.uint16)
        self.words = _keys(unpack(words, np.uint8)[0])
        self.at = low.astype(np.int64) | high.astype(np.int64) << 16
        self.held = flags & 1 == 1
        self.ids = pa.array(ids, mask=flags & 2 == 2)

    @property
    def pairs(self) -> np.ndarray:
        """The pair of each token: the place of its context and its own, 32 bits each. The last token of a chunk is an end token."""
        return np.concatenate((self.at[-1:], self.at[:-1])) << 32 | self.at

    def sides(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and word of pairs."""
        return self.words[pairs >> 32], self.words[pairs & 0xFFFFFFFF]

    @property
    def learned(self) -> np.ndarray:
        """Which tokens are of training documents."""
        return np.repeat(~self.held, self.counts)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Docs]]:
    for batch in batches:
        for chunk, words, docs in zip(batch.column("chunk").to_pylist(), batch.column("words"), batch.column("docs"), strict=True):
            yield chunk, _Docs(words.as_py(), docs.as_py())
    give_back()


def _in_groups(rows: DataFrame) -> DataFrame:
    """Pieces (grp, ord, blob) of a group in one task, in order."""
    return rows.select("grp", "ord", "blob").repartition(parts(rows.sparkSession), "grp").sortWithinPartitions("grp", "ord")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The pieces of one group after the other."""
    now, held = None, []
    for batch in batches:
        for group, ord_, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if group != now and held:
                yield now, held
                held = []
            now = group
            held.append((ord_, blob.as_py()))
    if held:
        yield now, held
    give_back()


PIECES = "kind int, grp int, ord int, n1 long, n2 long, blob binary"


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``PIECES``: kind, group or bucket, order inside it, a piece, and two numbers about it (0 where left out)."""
    kind, group, ord_, blob, n1, n2 = zip(*((*r, 0, 0)[:6] for r in rows), strict=True) if rows else [()] * 6
    ints, longs = pa.int32(), pa.int64()
    cols = [pa.array(kind, ints), pa.array(group, ints), pa.array(ord_, ints), pa.array(n1, longs), pa.array(n2, longs), pa.array(blob, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "grp", "ord", "n1", "n2", "blob"])


def _sums(table: DataFrame) -> tuple[int, int]:
    return tuple(table.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n2"), F.lit(0))).first())


def _count_words(chunks: DataFrame, groups: int, often: int) -> list[DataFrame]:
    """By group the sorted words of the training documents and their counts (n1: how many words); and those of more than ``often``."""

    def map_side(batches):
        for _, docs in _stored(batches):
            c = np.bincount(docs.at[docs.learned], minlength=len(docs.words))
            words, c = docs.words[c > 0], c[c > 0]
            yield _piece_rows([(0, g, 0, pack(_steps(w), n)) for g, (w, n) in _dealt(_home(words, groups), words, c)])

    def by_group(batches):
        for group, pieces in _by_group(batches):
            steps, counts = zip(*(unpack(p, np.uint8, np.int64) for _, p in pieces), strict=True)
            words, c = _summed(np.concatenate([_keys(x) for x in steps]), np.concatenate(counts))
            yield _piece_rows([(0, group, 0, pack(_steps(words), c), len(words)), (1, group, 0, pack(words[c > often], c[c > often]))])

    return materialize_by(_in_groups(chunks.mapInArrow(map_side, PIECES)).mapInArrow(by_group, PIECES), "lm-counts", "kind", (0, 1))


def _count_pairs(chunks: DataFrame, hot, wide, buckets: int, groups: int) -> DataFrame:
    """What the pairs come to, in pieces: kind 0 pairs of more than one (word, context, count) by the word's group, those of ``wide`` words by pair; kind 1
    contexts and their numbers of pairs of one, by the context's group; kind 2 words likewise; kind 3 the sorted keys of a bucket's pairs of one (n1: how many; n2: pairs of two there)."""

    def map_side(batches):
        for _, docs in _stored(batches):
            pairs = np.sort(docs.pairs[docs.learned])
            start = np.flatnonzero(_firsts(pairs))
            c = np.diff(start, append=len(pairs)).astype(np.uint32)
            context, word = docs.sides(pairs[start])  # by context, as the words are sorted
            bucket = _pair_bucket(context, _pair(context, word), hot.value, buckets)
            order = _by_bucket(bucket)
            context, word, c, bucket = context[order], word[order], c[order], bucket[order]
            ids, blobs = [], []
            for b, s in _pieces(bucket):
                start = np.flatnonzero(np.diff(context[s], prepend=~context[s][:1]))
                ids.append(b)
                blobs.append(pack(context[s][start], np.diff(np.append(start, s.stop - s.start)).astype(np.uint32), word[s], c[s]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def by_bucket(batches):
        now, held, repeated, ones, waiting = None, [], [], [], 0

        def settle():
            context = np.concatenate([np.repeat(u, runs) for u, runs, _, _ in held])
            word, c = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]).astype(np.int64)
            held.clear()
            key = _pair(context, word)
            order = np.argsort(key)
            key = key[order]
            start = np.flatnonzero(_firsts(key))
            total = np.add.reduceat(c[order], start) if len(start) else c
            key, context, word, one = key[start], context[order[start]], word[order[start]], total == 1
            repeated.append((word[~one], context[~one], total[~one]))
            ones.append((context[one], word[one]))
            return _piece_rows([(3, now, 2, pack(_steps(key[one])), int(one.sum()), int((total == 2).sum()))]), len(key)

        def deal():
            """What several buckets found goes to the groups at once."""
            word, context, n = (np.concatenate([r[i] for r in repeated]) for i in range(3))
            repeated.clear()
            order = np.argsort(word)
            word, context, n = word[order], context[order], n[order]
            out = [(0, g, 3, pack(_steps(w), u, k)) for g, (w, u, k) in _dealt(_pair_bucket(word, _pair(context, word), wide.value, groups), word, context, n)]
            for side in (0, 1):
                word, n = np.unique(np.concatenate([o[side] for o in ones]), return_counts=True)
                out += [(1 + side, g, 1 + side, pack(_steps(w), k)) for g, (w, k) in _dealt(_home(word, groups), word, n)]
            ones.clear()
            return _piece_rows(out)

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    if held:
                        settled, n = settle()
                        yield settled
                        waiting += n
                    if waiting > FLUSH_TOKENS:
                        yield deal()
                        waiting = 0
                    now = bucket
                held.append(unpack(blob.as_py(), np.uint64, np.uint32, np.uint64, np.uint32))
        if held:
            yield settle()[0]
        if repeated:
            yield deal()
        give_back()

    packed = chunks.mapInArrow(map_side, "bucket int, blob binary")
    dealt = packed.repartition(parts(chunks.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(by_bucket, PIECES)


# --- the sweeps ---------------------------------------------------------------------------------------------------------------


class Model:
    """Seats of all restaurants, in pieces by group. A word's group holds its state (``words``) and the pairs that end with it; pairs that end with one of the
    few words of more than ``limit`` tokens are dealt over all groups, so that no task gets one of them whole.

    ``words``: a group's sorted words, c, ones (contexts that hold the word once), ctx_ones (words that it holds once as a context), t0 (its tables in
    the parent) and, for each kept sweep, c0 (its customers there), t0 and the tables of its own restaurant. ``pairs``: the distinct words (dishes) and
    contexts of a group's pairs by their groups, the places of each pair's dish and context among them, c; ``seats``: t of each pair and its sum over kept sweeps.

    Pairs stay where they are. What travels is, for each group, the tables that its pairs have in each of their contexts and of each of their dishes (to the
    groups of these), and back the tables that the context has in all, and the dish's customers and tables in the parent. After the last
    sweep ``pairs`` are the pieces that scoring reads.
    """

    def __init__(self, counts: DataFrame, found: list[DataFrame], total: int, kinds: int, groups: int, limit: int, hot, buckets: int, n1: int, n2: int, seed: int):
        self.total, self.base, self.seed, self.groups, self.hot, self.buckets = total, 1.0 / (kinds + 1), seed, groups, hot, buckets
        self.d, self.theta = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2))), STRENGTH  # the usual estimate of the discount
        self.words, self.pairs, self.seats, self.told = self._gather([counts, *found], limit)
        release(counts, *found)
        n1, n2 = _sums(self.words)
        self.d0, self.theta0 = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2))), STRENGTH
        self.tables0, self.customers0 = float(kinds), 0.0
        self.kept: list[tuple[float, float]] = []
        self._parent(0)
        for sweep in range(1, SWEEPS + 1):
            self._contexts(sweep)
            self._parent(sweep)

    @property
    def unseen(self) -> list[float]:
        """The parent's share of an unknown word in each kept sweep."""
        return [(self.theta0 + self.d0 * tables0) * self.base / (self.theta0 + customers0) for tables0, customers0 in self.kept]

    def _step(self, tables: list[DataFrame], run: Callable, name: str, kinds: int) -> list[DataFrame]:
        rows = _in_groups(reduce(DataFrame.unionAll, [t.select("grp", "ord", "blob") for t in tables]))
        return materialize_by(rows.mapInArrow(run, PIECES), name, "kind", tuple(range(kinds)))

    def _gather(self, tables: list[DataFrame], limit: int) -> list[DataFrame]:
        """Groups of words, pairs and first seats, and what is told of them. n1, n2: words of one and of two customers in the parent (those of more
        than ``limit`` tokens have more, as the first tables are the square roots of counts)."""
        groups = self.groups

        def run(batches):
            for group, pieces in _by_group(batches):
                out, found = [], ([], [], [], [])
                for ord_, piece in pieces:
                    steps, *values = unpack(piece, np.uint8, *((np.uint64, np.int64) if ord_ == 3 else (np.int64,)))
                    found[ord_].append((_keys(steps), *values))
                counts, ctx_ones, ones, pairs = found
                if pairs:
                    word, context, n = (np.concatenate([p[i] for p in pairs]) for i in range(3))
                    (dishes, dish_at), (contexts, context_at) = _places(word, groups), _places(context, groups)
                    order = np.argsort(dish_at << 32 | context_at)
                    dish_at, context_at, n = dish_at[order], context_at[order], n[order]
                    t = np.floor(np.sqrt(n)).astype(np.int64)
                    fixed = pack(_steps(dishes), _steps(contexts), np.diff(dish_at, prepend=0).astype(np.uint32), context_at.astype(np.uint32), n)
                    out += [(1, group, -2, fixed), (2, group, -1, pack(t, np.zeros_like(t))), *_tell(3, group, groups, dishes, contexts, dish_at, context_at, t)]
                for words, c in counts:  # one, or none where the group has only pairs
                    as_context, as_word = np.zeros_like(c), np.zeros_like(c)
                    for side, rows in ((as_context, ctx_ones), (as_word, ones)):
                        for w, k in rows:
                            side[np.searchsorted(words, w)] += k
                    c0 = as_word.copy()
                    if pairs:
                        at = np.minimum(np.searchsorted(words, dishes), len(words) - 1)
                        own = words[at] == dishes
                        c0[at[own]] += np.bincount(dish_at, t, len(dishes)).astype(np.int64)[own]
                    c0 = c0[c <= limit]
                    state = pack(_steps(words), c, as_word, as_context, np.ones_like(c), c[:0])
                    out.append((0, group, -1, state, int((c0 == 1).sum()), int((c0 == 2).sum())))
                yield _piece_rows(out)

        return self._step(tables, run, "lm-groups", 4)

    def _parent(self, sweep: int) -> None:
        """The tables of all contexts are the parent's customers: count them and reseat the parent."""
        d, theta, tables0, base, seed = self.d0, self.theta0, self.tables0, self.base, self.seed * 100 + 2 * sweep
        kept, last = sweep > BURN_IN, sweep == SWEEPS

        def run(batches):
            for group, pieces in _by_group(batches):
                (_, own), *told = pieces
                steps, c, ones, ctx_ones, t0, before = unpack(own, np.uint8, *[np.int64] * 5)
                words, c0, tables, asked = _keys(steps), ones.copy(), ctx_ones.copy(), []
                for asker, piece in told:
                    contexts, of_contexts, dishes, of_dishes = unpack(piece, np.uint8, np.int64, np.uint8, np.int64)
                    at, dish = np.searchsorted(words, _keys(contexts)), np.searchsorted(words, _keys(dishes))
                    tables[at] += of_contexts
                    c0[dish] += of_dishes
                    asked.append((asker, at, dish))
                t0 = np.minimum(t0, c0)
                now = np.empty_like(t0)
                for s in (slice(i, i + DRAWN_ROWS) for i in range(0, len(words), DRAWN_ROWS)):
                    others = tables0 - t0[s]
                    weight = lambda i, k: (theta + d * (others[i] + k - 1)) * base  # noqa: B023, E731
                    log_new = lambda i, k: _rising(theta / d + others[i] + 1, k - 1) + (k - 1) * np.log(d * base)  # noqa: B023, E731
                    now[s] = draw_tables(c0[s], t0[s], weight, log_new, d, words[s], seed, sweep == 0)
                own = pack(steps, c, ones, ctx_ones, now, np.concatenate([before, c0, now, tables]) if kept else before)
                out = [(0, group, -1, own, int(now.sum()), int(c0.sum()))]
                yield _piece_rows(out if last else [*out, *((1, asker, group, pack(tables[at], c0[dish], now[dish])) for asker, at, dish in asked)])

        before = self.words, self.told
        self.words, self.answers = self._step([self.words, self.told], run, "lm-words", 2)
        release(*before)
        self.tables0, self.customers0 = (float(x) for x in _sums(self.words))
        if kept:
            self.kept.append((self.tables0, self.customers0))

    def _contexts(self, sweep: int) -> None:
        """Reseat the dishes of all contexts given the parent and the contexts' other tables."""
        d, theta, d0, theta0, base, seed = self.d, self.theta, self.d0, self.theta0, self.base, self.seed * 100 + 2 * sweep + 1
        tables0, customers0, kept, last, averaged = self.tables0, self.customers0, sweep > BURN_IN, sweep == SWEEPS, SWEEPS - BURN_IN
        groups, buckets, hot = self.groups, self.buckets, self.hot

        def run(batches):
            for group, pieces in _by_group(batches):
                (_, fixed), (_, seats), *told = pieces
                dishes, contexts, dish_at, context_at, count = unpack(fixed, np.uint8, np.uint8, np.uint32, np.uint32, np.int64)
                dishes, contexts, dish_at, context_at = _keys(dishes), _keys(contexts), np.cumsum(dish_at, dtype=np.int64), context_at.astype(np.int64)
                t, sums = unpack(seats, np.int64, np.int64)
                tables, c0, t0 = (np.concatenate(x) for x in zip(*(unpack(p, *[np.int64] * 3) for _, p in told), strict=True))
                if (len(tables), len(c0)) != (len(contexts), len(dishes)):
                    raise RuntimeError(f"a group of {len(contexts)} contexts and {len(dishes)} dishes was told of {len(tables)} and {len(c0)}")
                key, now = _pair(contexts[context_at], dishes[dish_at]), np.empty_like(t)
                for s in (slice(i, i + DRAWN_ROWS) for i in range(0, len(t), DRAWN_ROWS)):
                    now[s] = reseat(key[s], count[s], t[s], tables[context_at[s]], c0[dish_at[s]], t0[dish_at[s]])
                if kept:
                    sums = sums + now
                out = _tell(1, group, groups, dishes, contexts, dish_at, context_at, now)
                if last:  # the pair's customers less what its tables are discounted: over theta + c of its context, its own share
                    share = (count - d * sums / averaged).astype(np.float32)
                    order = np.argsort(key)
                    key, share, context = key[order], share[order], contexts[context_at[order]]
                    out += [(0, b, 1, pack(_steps(k), v)) for b, (k, v) in _dealt(_pair_bucket(context, key, hot.value, buckets), key, share)]
                else:
                    out.append((0, group, -1, pack(now, sums)))
                yield _piece_rows(out)

        def reseat(key, count, t, tables, c0, t0):
            # without this dish's tables, here and in the parent
            others, rest = c0 - t, theta / d + tables - t
            seats, all_others = np.minimum(t0, others), theta0 + customers0 - t
            back0 = (theta0 + d0 * tables0) * base
            own = others - d0 * np.maximum(seats, 1) + back0

            def weight(i, k):
                """The k-th table finds the parent with the dish's earlier tables sitting there."""
                return d * (rest[i] + k - 1) * (own[i] + k - 1) / (all_others[i] + k - 1)

            def log_new(i, k):
                return _rising(rest[i] + 1, k - 1) + (k - 1) * np.log(d) + _rising(own[i] + 1, k - 1) - _rising(all_others[i] + 1, k - 1)

            return draw_tables(count, t, weight, log_new, d, key, seed, sweep == 1)

        seats, self.told = self._step([self.pairs, self.seats, self.answers], run, "lm-seats", 2)
        release(self.seats, self.answers)
        if last:
            release(self.pairs)
            self.pairs = seats
        else:
            self.seats = seats


def _places(words: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words by their groups, sorted inside each, and the place of each word among them."""
    kinds, at = np.unique(words, return_inverse=True)
    order = _by_bucket(_home(kinds, groups))
    return kinds[order], _inverse(order)[at]


def _tell(kind: int, group: int, groups: int, dishes: np.ndarray, contexts: np.ndarray, dish_at: np.ndarray, context_at: np.ndarray, t: np.ndarray) -> list[tuple]:
    """Pieces of the tables of a group's pairs, in each context and of each dish, for the groups of these."""
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    told = defaultdict(lambda: [none, none])
    for side, (words, at) in enumerate(((contexts, context_at), (dishes, dish_at))):
        for g, piece in _dealt(_home(words, groups), words, np.bincount(at, t, len(words)).astype(np.int64)):
            told[g][side] = piece
    return [(kind, g, group, pack(_steps(u), k, _steps(w), n)) for g, ((u, k), (w, n)) in told.items()]


# --- questions and answers ------------------------------------------------------------------------------------------------------


class _Chunk:
    """The sorted distinct words and pairs of a chunk, by bucket; with ``places``, where each token finds its word, pair and context."""

    def __init__(self, docs: _Docs, hot: np.ndarray, buckets: int, places: bool = True):
        bucket = (mix(docs.words) % _U(buckets)).astype(np.int32)
        order = _by_bucket(bucket)
        self.word_bucket, self.words = bucket[order], docs.words[order]
        pairs = docs.pairs
        if places:
            self.word_at = _inverse(order)[docs.at]
            self.context_at = np.concatenate((self.word_at[-1:], self.word_at[:-1]))  # the last token of a chunk is an end token
            pairs, self.pair_at = _distinct(pairs)
        else:
            pairs.sort()
            pairs = pairs[_firsts(pairs)]
        context, word = docs.sides(pairs)
        del pairs
        key = _pair(context, word)
        order = np.argsort(key)
        bucket = _pair_bucket(context, key, hot, buckets)[order]
        del context, word
        by_bucket = _by_bucket(bucket)
        order, self.pair_bucket = order[by_bucket], bucket[by_bucket]
        self.pairs = key[order]
        if places:
            self.pair_at = _inverse(order)[self.pair_at]


def _ask(chunks: DataFrame, hot, buckets: int, turn: int) -> DataFrame:
    """bucket, ord (3 words, 4 pairs), chunk, blob: the sorted keys that a chunk asks a bucket of this turn for."""

    def run(batches):
        for name, docs in _stored(batches):
            chunk, out = _Chunk(docs, hot.value, buckets, places=False), []
            for kind, keys, where in ((3, chunk.words, chunk.word_bucket), (4, chunk.pairs, chunk.pair_bucket)):
                out += [(b, kind, pack(_steps(keys[s]))) for b, s in _pieces(where) if b % TURNS == turn]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([name] * len(out), pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["bucket", "ord", "chunk", "blob"])

    return chunks.mapInArrow(run, "bucket int, ord int, chunk long, blob binary")


def _answers(chunks: DataFrame, model: Model, singles: DataFrame, hot, buckets: int) -> list[DataFrame]:
    """The answers to all questions, ``TURNS`` parts of the buckets one after the other. More turns shuffle less at a time and ask for each chunk again."""
    stored, out = _state(model, buckets), []
    state = reduce(DataFrame.unionAll, [t.select(F.col("grp").alias("bucket"), "ord", F.lit(None).cast("long").alias("chunk"), "blob") for t in stored])
    for turn in range(TURNS):
        mine = lambda df, turn=turn: df.filter(F.col("bucket") % TURNS == turn)
        out.append(materialize(_answer(_ask(chunks, hot, buckets, turn), model, mine(state), mine(singles)), "lm-answers"))
        tidy(chunks.sparkSession, rounds=3)
    release(*stored)
    return out


def _state(model: Model, buckets: int) -> list[DataFrame]:
    """The state of words (ord 0) and pairs (1) in packed pieces by bucket, stored, dealt by the same code that the chunks use; the model's own tables go."""
    d, theta, d0, theta0, unseen, sizes = model.d, model.theta, model.d0, model.theta0, model.unseen, model.kept

    def run(batches):
        for _, pieces in _by_group(batches):
            for _, piece in pieces:
                steps, c, _, _, _, kept = unpack(piece, np.uint8, *[np.int64] * 5)
                words, v = _keys(steps), np.empty((len(c), 2 * len(sizes)), dtype=np.float32)
                for s, (c0, t0, tables) in enumerate(kept.reshape(len(sizes), 3, -1)):
                    v[:, 2 * s] = (c0 - d0 * t0) / (theta0 + sizes[s][1]) + unseen[s]
                    v[:, 2 * s + 1] = (theta + d * tables) / (theta + c)
                yield _piece_rows([(0, b, 0, pack(_steps(w), n, x)) for b, (w, n, x) in _dealt((mix(words) % _U(buckets)).astype(np.int32), words, c, v)])

    words = materialize(model.words.select("grp", "ord", "blob").mapInArrow(run, PIECES), "lm-state")
    release(model.words, model.told)
    return [words, model.pairs]


def _answer(asked: DataFrame, model: Model, state: DataFrame, singles: DataFrame) -> DataFrame:
    """chunk, kind (0 words, 1 pairs), bucket, blob: the values in the order of the questions.

    A word has its count and (p, back) of each kept sweep; a pair its mean own share times theta + c of its context, -1 where it was seen once.
    """
    null = lambda kind: F.lit(None).cast(kind)
    rows = state.unionAll(singles.select("bucket", "ord", null("long").alias("chunk"), "blob")).unionAll(asked)
    rows = rows.repartition(parts(asked.sparkSession), "bucket").sortWithinPartitions("bucket", "ord", "chunk")
    unknown = np.array([x for p in model.unseen for x in (p, 1.0)], dtype=np.float32)
    width = len(unknown)

    def run(batches):
        now, state, sorted_ = None, None, False

        def ready():
            """Sorted tables of the bucket: words with counts and values, pairs with shares, pairs of one."""
            words, pairs, ones_ = state
            w = np.concatenate([x[0] for x in words]) if words else np.zeros(0, dtype=np.uint64)
            order = np.argsort(w)
            n = np.concatenate([x[1] for x in words])[order] if words else np.zeros(0, dtype=np.int64)
            v = np.concatenate([x[2] for x in words])[order] if words else np.zeros((0, width), dtype=np.float32)
            p = np.concatenate([x[0] for x in pairs]) if pairs else np.zeros(0, dtype=np.uint64)
            by_key = np.argsort(p)
            share = np.concatenate([x[1] for x in pairs])[by_key] if pairs else np.zeros(0, dtype=np.float32)
            one = np.sort(np.concatenate(ones_)) if ones_ else np.zeros(0, dtype=np.uint64)
            return w[order], n, v, p[by_key], share, one

        def find(keys, table):
            at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
            return at, (table[at] == keys if len(table) else np.zeros(len(keys), dtype=bool))

        for batch in batches:
            buckets_, kinds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out = []
            for _, s in _pieces(np.cumsum(np.append(0, (np.diff(buckets_) != 0) | (np.diff(kinds) != 0)))):
                bucket, kind = int(buckets_[s.start]), int(kinds[s.start])
                part = batch.slice(s.start, s.stop - s.start)
                if bucket != now:
                    now, state, sorted_ = bucket, ([], [], []), False
                if kind < 3:
                    for piece in part.column(3).to_pylist():
                        key, *values = unpack(piece, np.uint8, *((np.int64, np.float32), (np.float32,), ())[kind])
                        key = _keys(key)
                        state[kind].append((key, values[0], values[1].reshape(len(key), width)) if kind == 0 else (key, *values) if kind == 1 else key)
                    continue
                if not sorted_:
                    table, sorted_ = ready(), True
                w, n, v, p, share, one = table
                for chunk, blob in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                    keys = _keys(unpack(blob.as_py(), np.uint8)[0])
                    if kind == 3:
                        at, hit = find(keys, w)
                        count, values = np.zeros(len(keys), dtype=np.int64), np.tile(unknown, (len(keys), 1))
                        count[hit], values[hit] = n[at[hit]], v[at[hit]]
                        out.append((chunk, 0, bucket, pack(count, values)))
                    else:
                        at, hit = find(keys, p)
                        values = np.zeros(len(keys), dtype=np.float32)
                        values[hit] = share[at[hit]]
                        values[find(keys, one)[1]] = -1
                        out.append((chunk, 1, bucket, pack(values)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())], names=["chunk", "kind", "bucket", "blob"])

    return rows.mapInArrow(run, "chunk long, kind int, bucket int, blob binary")


def _meet(chunks: DataFrame, answers: DataFrame, model: Model, kinds: int, hot, buckets: int) -> DataFrame:
    """Documents and answers of a chunk in one task."""
    said = chunks.select("chunk", F.lit(2).alias("kind"), F.lit(0).alias("bucket"), F.col("docs").alias("blob"), "words")
    told = answers.select("chunk", "kind", "bucket", "blob", F.lit(None).cast("binary").alias("words"))
    both = told.unionAll(said).repartition(parts(chunks.sparkSession), "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    total, d, theta, kept = model.total, model.d, model.theta, SWEEPS - BURN_IN
    floor = total + 0.1 * (kinds + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def scored(words, pairs, docs):
        chunk = _Chunk(docs, hot.value, buckets)
        count = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in words)])
        values = np.concatenate([np.zeros((0, 2 * kept)), *(x[1].reshape(len(x[0]), 2 * kept) for x in words)])
        share = np.concatenate([np.zeros(0), *pairs])
        if len(count) != len(chunk.words) or len(share) != len(chunk.pairs):
            raise RuntimeError(f"a chunk of {len(chunk.words)} words and {len(chunk.pairs)} pairs has answers for {len(count)} and {len(share)}")
        share = share[chunk.pair_at]
        c_ctx = count[chunk.context_at]
        share = np.where(share < 0, 1 - d, share) / (theta + c_ctx)
        back = sum(values[chunk.context_at, 2 * s + 1] * values[chunk.word_at, 2 * s] for s in range(kept)) / kept
        of_token = (np.log10((count + 0.1) / floor)[chunk.word_at], np.log10(share + back), (count > 0)[chunk.word_at].astype(np.float64))
        n = docs.counts
        base, own, known = (np.add.reduceat(x, np.cumsum(n) - n) for x in of_token)
        cols = [docs.ids, pa.array(docs.held), pa.array(n), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(len(n), total, dtype=np.int64)), pa.array(base), pa.array(own), pa.array(10 ** np.minimum(300.0, -own / n))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        now, words, pairs = None, [], []
        for batch in batches:
            for chunk, kind, blob, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if chunk != now:
                    now, words, pairs = chunk, [], []
                if kind == 0:
                    words.append(unpack(blob.as_py(), np.int64, np.float32))
                elif kind == 1:
                    pairs.append(unpack(blob.as_py(), np.float32)[0])
                else:
                    yield scored(words, pairs, _Docs(own.as_py(), blob.as_py()))

    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: object = None, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    modest_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)) if held is None else held
    rows = rows.withColumn("held_out", F.coalesce(held, F.lit(False)))
    chunks = materialize(_chunks(rows), "lm-chunks")  # their numbers are drawn, so they are written before anything reads them
    total = int(chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    groups, buckets = max(1, -(-total // GROUP_TOKENS)), max(1, -(-total // BUCKET_TOKENS))
    counts, tops = _count_words(chunks, groups, total // HOT)
    kinds = int(_sums(counts)[0])
    often = [unpack(r["blob"], np.uint64, np.int64) for r in tops.select("blob").collect()]  # at most HOT words
    often, n = (np.concatenate([np.zeros(0, kind), *(o[i] for o in often)]) for i, kind in enumerate((np.uint64, np.int64)))
    limit = GROUP_TOKENS // 8
    hot, wide = (spark.sparkContext.broadcast(np.sort(x)) for x in (often, often[n > limit]))
    *found, singles = materialize_by(_count_pairs(chunks, hot, wide, buckets, groups), "lm-pair-counts", "kind", (0, 1, 2, 3))
    where = singles._scratch
    n1, n2 = _sums(singles)
    singles = singles.withColumnRenamed("grp", "bucket")
    singles._scratch = where
    tidy(spark, rounds=3)
    model = Model(counts, found, total, kinds, groups, max(limit, total // HOT), hot, buckets, n1, n2, seed)
    release(tops)
    answers = _answers(chunks, model, singles, hot, buckets)
    release(singles)
    told, out = reduce(DataFrame.unionAll, answers), []
    for turn in range(TURNS):  # a turn's shuffle, a copy of its chunks and answers, is gone before the next one's
        mine = lambda df, turn=turn: df.filter(F.col("chunk") % TURNS == turn)
        out.append(materialize(_meet(mine(chunks), mine(told), model, kinds, hot, buckets), "lm-scores"))
        tidy(spark, rounds=3)
    release(chunks, *answers)
    return reduce(DataFrame.unionAll, out)
