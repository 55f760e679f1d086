"""Line dedup against a brute-force version, and its perfect hash."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwarden.llm import line_dedup

BLANK = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    """rows (id, text) -> sorted (id, n_lines, n_dropped, text)."""
    holders = {}
    for at, (d, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            holders.setdefault(line.strip(BLANK).translate(LOWER), set()).add((-1 << 63 if d is None else d, at))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stays = []
        for line in lines:
            key = line.strip(BLANK).translate(LOWER)
            if len(key) < min_chars or len(holders[key]) < min_docs or max(h[0] for h in holders[key]) == (-1 << 63 if d is None else d):
                stays.append(line)
        out.append((d, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return sorted(out, key=repr)


def made(seed=3, n=60):
    r = random.Random(seed)
    pool = ["Accept all cookies and go on ", "  accept ALL cookies and go on", "Ä ö ü ß und noch zwanzig Zeichen", "\tshort", "", "x" * 19, "é" * 20, "É" * 20, "K" * 25, "K" * 25, "\x1f" + "a" * 30, "a" * 30]
    rows = [(i, "\n".join(r.choice([r.choice(pool), f"only in {i} and {r.random()}"]) for _ in range(r.randint(0, 9)))) for i in r.sample(range(1000), n)]
    return [*rows, (5000, None), (5001, ""), (5002, "\n\n"), (5003, "\n".join([pool[0]] * 4)), (5004, pool[1] + "\r\n" + pool[1] + "\v")]


def rows_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"shard_keys": 2}, {"shard_keys": 1, "round_bytes": 1}])
def test_lines_of_any_number_of_shards_and_rounds_are_those_of_brute_force(spark, options):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "keeper": F.lit("x"), "id": F.lit(9)}).repartition(3)
    got = rows_of(line_dedup.dedup_lines(df, **options))
    assert got == brute(rows) and sum(x[2] for x in got) > 20


def test_lines_parameters_ties_repeated_and_null_ids(spark):
    line = "a line that is long enough to count"
    rows = [(7, line), (7, line + "\nown"), (None, line), (None, "b\n" + line), (3, line), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(line_dedup.dedup_lines(df)) == brute(rows)
    nulls = [(None, line), (None, line), (None, line)]
    assert rows_of(line_dedup.dedup_lines(spark.createDataFrame(nulls, "doc_id long, text string"))) == brute(nulls)
    short = [(i, "abc\nabd") for i in range(2)]
    assert rows_of(line_dedup.dedup_lines(spark.createDataFrame(short, "doc_id long, text string"), min_chars=3, min_docs=2)) == brute(short, 3, 2)


def test_lines_of_the_shared_rows_and_of_no_rows(docs, rows, empty):
    assert rows_of(line_dedup.dedup_lines(docs)) == brute([(r[0], r[1]) for r in rows])
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_a_text_beyond_a_batch(spark):
    hot = "the same words in each of these documents"
    long = "\n".join([hot, *(f"line {i} of a very long text" for i in range(400_000))])
    rows = [(1, long), (2, hot), (3, hot + "\nend")]
    assert rows_of(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_perfect_hash_numbers_its_keys_without_gaps(n):
    r = np.random.RandomState(n)
    high, low = (r.randint(0, 1 << 63, n + 200, dtype=np.uint64) for _ in range(2))
    shard = line_dedup.Shard.of(high[:n], low[:n], np.arange(n), -np.arange(n, dtype=np.int64))
    again = line_dedup.Shard.from_bytes(shard.to_bytes())
    at = again.find(high, low)
    assert sorted(at[:n]) == list(range(n)) and (at[n:] == -1).all()
    assert (again.counts[at[:n]] == np.arange(n)).all() and (again.keepers[at[:n]] == -np.arange(n)).all()
    assert len(again.index.words) * 64 < 5 * n + 1000
