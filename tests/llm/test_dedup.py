import hashlib
import re
from collections import defaultdict

import pytest

from spanwarden.llm import byte_dedup, exact_dedup, ngram_join, substring_dedup, windows

from .conftest import WORD


def test_exact(docs, rows, empty):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, d in members:
            r = got[d]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert len(got) == len(rows) and exact_dedup.exact_dedup(empty).count() == 0


def shingles(text):
    words = WORD.findall((text or "").encode().lower().decode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def classes(rows):
    sets = {d: shingles(t) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("small", [32, 3])
def test_jaccard_classes_are_those_of_all_pairs(docs, rows, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    want = classes(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == want
    assert sorted(len([1 for v in want.values() if v[1] == c]) for c in {v[1] for v in want.values()})[-1] > 3


def test_jaccard_edges(spark, docs, empty):
    assert ngram_join.jaccard_classes(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, (r["component_id"] for r in ngram_join.jaccard_classes(odd).collect()))) == ["1", "1", "None"]


def test_sketches_bound_the_difference():
    import numpy as np

    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:2600], r.integers(0, 1 << 63, 500, dtype=np.uint64))))
    differ = len(np.setxor1d(a, b))
    assert ngram_join.hamming(ngram_join.wide_sketch(a), ngram_join.wide_sketch(b)) <= differ
    levels = np.zeros(ngram_join.COUNTERS, dtype=np.uint8)
    assert set(ngram_join.sketch_keys(a, levels)) & set(ngram_join.sketch_keys(b, levels))


def byte_truth(rows, length):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(data[i : i + length])
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("many", [20_000, 2])
def test_bytes(docs, rows, empty, many, monkeypatch):
    monkeypatch.setattr(windows, "GROUP_ROWS", many)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in byte_dedup.dedup_bytes(docs).collect()}
    assert got == byte_truth(rows, 100) and sum(v[1] for v in got.values()) > 1000
    assert byte_dedup.dedup_bytes(empty).count() == 0


def word_truth(rows, n):
    first, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t, *_ in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), d)
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("many", [20_000, 2])
def test_words(docs, rows, empty, many, monkeypatch):
    monkeypatch.setattr(windows, "GROUP_ROWS", many)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_words(docs).collect()}
    assert got == word_truth(rows, 13) and sum(v[1] for v in got.values()) > 100
    assert substring_dedup.dedup_words(empty).count() == 0


def test_rows_without_or_with_one_id(spark):
    t = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame([(None, t), (None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.dedup_words(odd).collect()) == [("1", 0), ("1", 0), ("2", 60), ("None", 0), ("None", 0)]
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in byte_dedup.dedup_bytes(odd).collect()) == [("1", 0), ("1", 0), ("2", len(t)), ("None", 0), ("None", 0)]


def test_texts_longer_than_a_slice(spark):
    import random

    from spanwarden.llm.common import GROUP_BYTES

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    long = " ".join(r.choice(words) for _ in range(220_000))
    assert len(long) > GROUP_BYTES
    rows = [(1, long), (2, long[:400_000] + " new " + long[600_000:700_000]), (3, long), (4, "short " * 30), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.dedup_words(df).collect()}
    assert got == word_truth(rows, 13)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], len(x["removed"]), x["kept_sha256"]) for x in byte_dedup.dedup_bytes(df).collect()}
    assert got == byte_truth(rows, 100)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.jaccard_classes(df).collect()}
    assert got == classes(rows)
    assert {x["doc_id"]: x["keep_id"] for x in exact_dedup.exact_dedup(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
