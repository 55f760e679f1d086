"""N-gram Jaccard join by parity sketches, and the classes of linked documents.

A document's set are its distinct shingles of ``SHINGLE`` words (with fewer words, the whole sequence; without words,
empty and linked with nothing). Two documents link when 100 * intersection >= ``percent`` * union; at 75 the
symmetric difference is then at most a third of the smaller set.

* Equal sets share a fingerprint and are one vertex from the start, so groups of copies cost one vertex.
* The parity sketch of a set has ``p`` segments (p by size band); a segment is the XOR of the 64-bit hashes of the
  shingles that fall into it. Each differing shingle touches one segment, so of any d + 1 non-empty segments, taken in
  one global order, two linked sets share at least one (pigeonhole). Sets near a band's edge are sketched for the next
  band too. The order puts segments of rare shingles first, by 2^20 counters over the whole corpus; these have a fixed
  size and steer speed only.
* A second sketch of ``BITS`` parity bits bounds the symmetric difference from below by its Hamming distance and rejects
  candidates before they are verified on whole sets; sets of more than ``WIDE`` shingles have a longer one as well.
* In a bucket of at most ``SMALL`` sets all pairs are candidates. In a larger one each set is paired with the first and with
  its predecessor; once components are known, every pair of sets of such a bucket in two components is compared
  (``_rest``), so the classes are those of all links while a hot bucket's links inside one class are not listed.

``n_links`` counts the verified links of a document's set that were needed to connect its class (a lower bound of all).
Rows without an id are left out of the search and stay alone; rows that repeat an id count as one document; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, Words, give_back, groups, materialize, mix, modest_batches, parts, signed
from .components import components

SHINGLE = 5
PERCENT = 75
BITS = 1024
LONGS = BITS // 64
COUNTERS = 1 << 20
CHUNK = 1 << 14
SMALL = 32
TINY = 128
WIDE = 512
BLOOM_BITS = 1 << 23
_U = np.uint64


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    words = Words(texts, lower=True)
    ranges = RangeHash(words.hashes)
    grams = ranges.grams(shingle)
    bounds = words.bounds
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < shingle))
    whole = dict(zip(short.tolist(), mix(ranges.ranges(bounds[short], bounds[short + 1]) ^ n[short].astype(np.uint64)), strict=True))
    empty = np.zeros(0, dtype=np.uint64)
    return [np.unique(grams[a : b - shingle + 1]) if b - a >= shingle else np.array([whole[i]], dtype=np.uint64) if b > a else empty for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits of a set: sum and XOR of its hashes, mixed with its size."""
    a = mix(np.array([hashes.sum(dtype=np.uint64)]) ^ _U(len(hashes)))
    return int(mix(a + np.bitwise_xor.reduce(hashes)).view(np.int64)[0])


def wide_sketch(hashes: np.ndarray) -> bytes:
    """Parity bits, at least two for each shingle; the bit is the hash modulo their number, so halves fold by XOR."""
    bits = 1 << (2 * len(hashes) - 1).bit_length()
    return np.packbits((np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def hamming(x: bytes, y: bytes) -> int:
    """Distance of two wide sketches, the longer one folded to the length of the other."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _info(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, set_id long, n long, wide binary, " + ", ".join(f"s{i} long" for i in range(LONGS))

    def run(batches):
        for batch, texts in groups(batches):
            sets = shingle_sets(texts)
            bits = np.zeros((len(sets), BITS), dtype=np.uint8)
            for i, s in enumerate(sets):
                bits[i] = np.bincount((s >> _U(54)).astype(np.int64), minlength=BITS) & 1
            longs = np.packbits(bits, axis=1).view(np.int64)
            ids = [fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_sketch(s) if len(s) > WIDE else None for s in sets], pa.binary()), *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(LONGS))], names=["doc_id", "set_id", "n", "wide", *(f"s{i}" for i in range(LONGS))])

    return docs.mapInArrow(run, schema)


def _levels(docs: DataFrame) -> np.ndarray:
    """For each counter how hot it is: 0 within three deviations of the mean, then one more for each doubling."""

    def count(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for _, texts in groups(batches):
            some = np.concatenate(shingle_sets(texts))
            total += np.bincount((some & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield from _chunks(total)

    def _chunks(total):
        starts = [i for i in range(0, COUNTERS, CHUNK) if total[i : i + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK for i in starts], pa.int32()), pa.array([total[i : i + CHUNK].tobytes() for i in starts], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[chunk * CHUNK : (chunk + 1) * CHUNK] += np.frombuffer(counts, dtype=np.int64)
        yield from _chunks(total)

    counted = docs.select("text").mapInArrow(lambda it: count(_as_second(it)), "chunk int, counts binary")
    total = np.zeros(COUNTERS, dtype=np.int64)
    for row in counted.repartition(16, "chunk").mapInArrow(add, "chunk int, counts binary").toLocalIterator():  # 8 MB in all
        total[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] += np.frombuffer(row["counts"], dtype=np.int64)
    # rare shingles fill a counter to its mean, give or take the root of it; what stands out by more is hot
    mean = total.mean()
    above = (total - mean) / max(1.0, np.sqrt(mean))
    return np.where(above < 3, 0, np.minimum(1 + np.log2(np.maximum(above, 3) / 3), 63)).astype(np.uint8)


def _as_second(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0)], names=["text"])


def _band(n: int) -> int:
    """Segments of a sketch: a power of sixteen of at least twice the size; tiny sets have one for each shingle."""
    p = 4096
    while p < 2 * n:
        p *= 16
    return p if n > TINY else 1 << 40


def sketch_keys(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The segments that a set is joined by."""
    n = len(hashes)
    out = []
    hot = levels[(hashes & _U(COUNTERS - 1)).astype(np.int64)]
    for p in {_band(n), _band(-(-4 * n // 3))}:
        segment = (hashes >> _U(20)) & _U(p - 1)
        order = np.argsort(segment, kind="stable")
        at = segment[order]
        first = np.flatnonzero(np.diff(at, prepend=at[:1] + _U(1)))
        value = np.bitwise_xor.reduceat(hashes[order], first)
        level = np.minimum.reduceat(hot[order], first)
        keys = mix(value ^ mix(at[first] ^ _U(p << 20)))
        need = n // 3 + 1
        if need < len(keys):
            rank = (level.astype(np.uint64) << _U(56)) | (keys >> _U(8))
            keys = keys[np.argpartition(rank, need)[:need]]
        out.append(keys)
    return np.concatenate(out)


def _keys(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # one byte a counter

    def run(batches):
        hot_of = shared.value
        for _, texts in groups(_as_second(batches)):
            keys, ids, cold = [], [], []
            for s in {x.tobytes(): x for x in shingle_sets(texts) if len(x)}.values():
                k = sketch_keys(s, hot_of)
                keys.append(k)
                ids.append(np.full(len(k), fingerprint(s)))
                cold.append(np.full(len(k), min(32000, int((hot_of[(s & _U(COUNTERS - 1)).astype(np.int64)] == 0).sum())), dtype=np.int16))
            if keys:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(cold))], names=["key", "id", "cold"])

    return docs.select("text").mapInArrow(run, "key long, id long, cold short")


def _bucket_pairs(keys: DataFrame) -> DataFrame:
    """Candidates (a, b, key null), and the members of large buckets (a = b, key)."""

    def table(pairs, key=None):
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        new = np.ones(len(lo), dtype=bool)
        new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        return pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new]), pa.nulls(int(new.sum()), pa.int64())], names=["a", "b", "key"])

    def members(key, ids):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(key)], names=["a", "b", "key"])

    def settle(key, ids):
        size = np.diff(np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key)))
        size = np.repeat(size, size)
        small = (size > 1) & (size <= SMALL)
        k, i = key[small], ids[small]
        pairs = []
        for lag in range(1, SMALL):
            same = np.flatnonzero(k[lag:] == k[:-lag]) if len(k) > lag else np.zeros(0, dtype=np.int64)
            if not len(same):
                break
            pairs.append((i[same], i[same + lag]))
        large = size > SMALL
        k, i = key[large], ids[large]
        if len(k):
            start = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
            lead = i[np.repeat(start, np.diff(np.append(start, len(k))))]
            inner = np.ones(len(k), dtype=bool)
            inner[start] = False
            at = np.flatnonzero(inner)
            pairs += [(lead[at], i[at]), (i[at - 1], i[at])]
            yield members(k, i)
        yield table(pairs)

    def run(batches):
        held_key, held_ids, state = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None  # state: key, first and last id of a bucket that is passed through
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if state:
                n = int(np.argmax(key != state[0])) if (key != state[0]).any() else len(key)
                if n:
                    row = np.concatenate(([state[2]], ids[:n]))
                    row = row[np.append(True, row[1:] != row[:-1])]
                    if len(row) > 1:
                        yield members(np.full(len(row) - 1, state[0]), row[1:])
                        yield table([(np.full(len(row) - 1, state[1]), row[1:]), (row[:-1], row[1:])])
                    state = (state[0], state[1], row[-1])
                key, ids = key[n:], ids[n:]
                if not len(key):
                    continue
                state = None
            key, ids = np.concatenate((held_key, key)), np.concatenate((held_ids, ids))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids = key[new], ids[new]
            other = np.flatnonzero(key != key[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from settle(key[:last], ids[:last])
            held_key, held_ids = key[last:], ids[last:]
            if len(held_key) > 4096:
                yield from settle(held_key, held_ids)
                state = (held_key[0], held_ids[0], held_ids[-1])
                held_key = held_ids = np.zeros(0, dtype=np.int64)
        if len(held_key):
            yield from settle(held_key, held_ids)
        give_back()

    return keys.repartition(parts(keys.sparkSession), "key").sortWithinPartitions("key", "cold", "id").mapInArrow(run, "a long, b long, key long")


def _near(percent: int):
    """Native test of two rows of sets (columns of x and y): sizes and the sketches' Hamming distance allow a link."""

    def test(x: str, y: str):
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(LONGS)])
        sizes = (n * 100 >= m * percent) & (m * 100 >= n * percent)
        return sizes & (apart * (100 + percent) <= (n + m) * (100 - percent))

    return test


def _likely(pairs: DataFrame, sets: DataFrame, near, percent: int) -> DataFrame:
    """The pairs whose sizes, then sketches, then (of large sets) wide sketches allow a link."""
    sketch = [f"s{i}" for i in range(LONGS)]

    def both(rows: DataFrame, *columns: str) -> DataFrame:
        for c in ("a", "b"):
            rows = rows.join(sets.select(F.col("set_id").alias(c), F.struct(*columns).alias(f"_{c}")), c)
        return rows

    n, m = F.col("_a.n"), F.col("_b.n")
    pairs = both(pairs, "n").filter((n * 100 >= m * percent) & (m * 100 >= n * percent)).select("a", "b")
    pairs = materialize(both(pairs, "n", *sketch).filter(near("_a", "_b")).select("a", "b", F.least(n, m).alias("n")), "pairs")

    def run(batches):
        for batch in batches:
            na, nb, wa, wb = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [hamming(x, y) * (100 + percent) <= (p + q) * (100 - percent) for p, q, x, y in zip(na, nb, wa, wb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    large = both(pairs.filter(F.col("n") > WIDE).select("a", "b"), "n", "wide").select("a", "b", n.alias("na"), m.alias("nb"), F.col("_a.wide").alias("wa"), F.col("_b.wide").alias("wb"))
    return pairs.filter(F.col("n") <= WIDE).select("a", "b").unionAll(large.mapInArrow(run, "a long, b long"))


def _bloom(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id, ``BLOOM_BITS`` in all, gathered a word at a time: at most a megabyte."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS))
    words = ids.select(bit.alias("bit")).selectExpr("CAST(bit DIV 64 AS INT) AS w", "shiftleft(1L, CAST(bit % 64 AS INT)) AS v").groupBy("w").agg(F.bit_or("v").alias("v"))
    got = words.toArrow()
    out = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select(F.col("b").alias("set_id"))).distinct()
    # a fixed-size filter lets the scan itself make the sets of (nearly) only the wanted documents; no text is shuffled
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(sets.join(wanted, "set_id", "left_semi").select(F.col("first_doc").alias("doc_id"))))

    def build(batches):
        have = bits.value
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False)
            for part, texts in groups(iter([batch.filter(pa.array((have[at >> 6] >> (at & 63)) & 1 == 1))])):
                made = [s for s in shingle_sets(texts) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["set_id", "hashes"])

    hashed = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)).alias("at"))
    whole = hashed.mapInArrow(build, "set_id long, hashes binary").join(wanted, "set_id", "left_semi")
    whole = whole.repartition(parts(docs.sparkSession), "set_id")
    joined = pairs.join(whole.select(F.col("set_id").alias("b"), F.col("hashes").alias("hb")), "b").join(whole.select(F.col("set_id").alias("a"), F.col("hashes").alias("ha")), "a").select("a", "b", "ha", "hb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return joined.mapInArrow(run, "a long, b long").distinct()


def _rest(found: DataFrame, labels: DataFrame, sets: DataFrame, near) -> DataFrame:
    """Pairs of a large bucket whose sets are in two components, as far as sizes and sketches allow a link."""
    rows = found.filter("key IS NOT NULL").select("key", F.col("a").alias("set_id")).join(labels.select(F.col("id").alias("set_id"), "component"), "set_id", "left")
    rows = rows.withColumn("component", F.coalesce("component", "set_id"))
    main = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    rows = materialize(rows.join(main.select("key", "main"), "key").join(sets.drop("wide"), "set_id"), "large-buckets")
    x, y = rows.filter("component <> main").alias("x"), rows.alias("y")
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & near("x", "y"))
    return cross.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    modest_batches(docs.sparkSession)
    near = _near(percent)
    info = materialize(_info(docs), "sets")
    sketch = [f"s{i}" for i in range(LONGS)]
    sets = info.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("wide").alias("wide"), *[F.first(c).alias(c) for c in sketch])
    sets = materialize(sets, "distinct-sets")
    known = docs.filter("doc_id IS NOT NULL")
    found = materialize(_bucket_pairs(_keys(known, _levels(known))).distinct(), "candidates")
    pairs = found.filter("key IS NULL").select("a", "b")
    pairs = materialize(_likely(pairs, sets, near, percent), "pairs")
    links = materialize(_verify(known, sets, pairs, percent), "links")
    labels = components(links)
    more = materialize(_likely(_rest(found, labels, sets, near).join(pairs, ["a", "b"], "left_anti"), sets, near, percent), "pairs")
    if more.limit(1).count():
        more = materialize(_verify(known, sets, more, percent), "links")
        if more.limit(1).count():
            links = links.unionAll(more)
            labels = components(links)
    degree = links.select(F.col("a").alias("set_id")).unionAll(links.select(F.col("b").alias("set_id"))).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
    named = sets.select("set_id", "first_doc").join(labels.select(F.col("id").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = named.join(least, "component").select("set_id", "component_id").join(degree, "set_id", "left")
    out = info.select("doc_id", "set_id", F.col("n").alias("n_shingles")).join(named, "set_id", "left")
    alone = F.col("doc_id").isNull() | F.col("set_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of one document (the smallest id) of each class, with all their columns."""
    kept = jaccard_classes(docs, id_col, text_col, percent).filter("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")
