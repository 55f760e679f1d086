"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwarden.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "word string, form string, root string, n long, n_near long, form_n long"


def observed(rows):
    total = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = observed(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def made(seed=1, n=80):
    """Few stems in many spellings, of very different frequencies, so that forms chain and halves are shared."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcé") for _ in range(r.choice([6, 7, 8, 9, 12, 30]))) for _ in range(12)] + ["concentration", "concentrations", "consecration", "ÀÉÎÕÜß÷ÿ"]

    def spelt(w):
        for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2, 3])):
            i, c = r.randrange(len(w)), r.choice("abcé")
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]]) or "a"
        return w

    rows = [(i, r.choice([" ", ", ", "1"]).join(spelt(stems[min(r.randrange(16), r.randrange(16))]) for _ in range(r.randint(0, 150)))) for i in range(n)]
    chain = "chained " * 2 + "chainedb " * 25 + "chainedbd " * 300
    return [*rows, (950, chain), (900, None), (901, ""), (None, "Concentration concentratiom " * 3), (902, "a" * 3000 + " " + "a" * 3001 + " " + "a" * 3000 + " " + "a" * 3001), (902, "concentration"), (903, "漢字 _x9 " * 4)]


def result(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("options", [{}, {"group_words": 3}, {"group_words": 40}])
def test_variants_are_those_of_brute_force_however_groups_are_cut(spark, options):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "block": F.lit(1), "word": F.lit("w"), "n": F.lit(5)}).repartition(5)
    want = brute(rows)
    assert result(spelling.variants(df, **options)) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[2] != r[1] for r in want)


def test_variants_of_the_shared_rows_and_of_no_rows(docs, rows, empty):
    assert result(spelling.variants(docs)) == brute([(r[0], r[1]) for r in rows])
    assert spelling.variants(empty).count() == 0


def test_a_group_of_many_words_is_cut_until_it_is_small(spark):
    """Nine thousand words share their first half and most of them also the second."""
    r = random.Random(4)
    words = {"hotstem" + "".join(r.choice("abcdefgh") for _ in range(4)) + r.choice(["ending", "endings"]) for _ in range(9000)}
    frame = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    sizes = [x["count"] for x in spelling.blocks(frame, 200).groupBy("key").count().collect()]
    assert max(sizes) <= 200
    rows = [(i, " ".join(sorted(words)[i::40]) + " " + " ".join(sorted(words)[i::40])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["word"]: x["n_near"] for x in spelling.variants(df, group_words=200, every=10**9).collect()}
    letters = "abcdefgh"
    near = lambda w: sum(w[:i] + c + w[i + 1 :] in words for i in range(7, 11) for c in letters if c != w[i]) + ((w + "s") in words or w[:-1] in words)
    assert got == {w: near(w) for w in words}


def test_near_pairs_are_found_once_and_verified():
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.choice([7, 8]))) for _ in range(150)}, key=lambda w: (len(w), w))
    ones = np.zeros(len(words), dtype=np.int64)
    i, j = spelling.near_pairs([w.encode() for w in words], ones, ones + 7, ones + spelling.ALWAYS, tile=16)
    got = sorted(tuple(sorted((words[a], words[b]))) for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert got == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b) and min(len(a), len(b)) == 7)
