import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwarden.llm import mixing, token_output
from spanwarden.llm.common import read

from .conftest import WORD


def test_targets():
    got = mixing.source_targets({"b": 100, "a": 100, None: 10})
    assert got[None] == 30 and got["a"] == pytest.approx(60) and got["b"] == pytest.approx(120) and sum(got.values()) == pytest.approx(210)
    assert mixing.source_targets({}) == {} and mixing.source_targets({"a": 0}) == {"a": 0.0}


def test_flow_of_overlapping_sources():
    flow = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 10.0, "b": 10.0})
    assert flow == {(("a",), "a"): 10, (("a", "b"), "b"): 10}  # nothing is repeated while unused words are left
    # "a" comes first and could take the shared words, but then "b" would have none: they are rerouted
    flow = mixing.route({("a", "b"): 10, ("a", "c"): 10}, {"a": 10.0, "b": 10.0, "c": 0.0})
    assert {k: v for k, v in flow.items() if v} == {(("a", "b"), "b"): 10, (("a", "c"), "a"): 10}
    # repetition starts only when all words are used, and no pattern is used more than three times
    flow = mixing.route({("a",): 10, ("b",): 10}, {"a": 25.0, "b": 40.0})
    assert flow == {(("a",), "a"): 25, (("b",), "b"): 30}


def test_rows_without_a_source_are_one_source(spark):
    rows = [(1, "a b c", None), (2, "a b c", []), (3, "a b", [None]), (4, "x y", ["s"]), (5, None, ["s"])]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()}
    assert {i: r["source_size"] for i, r in got.items()} == {1: 8, 2: 8, 3: 8, 4: 2, 5: 2} and got[5]["taken"] == 0


def test_documents_behind_the_edge_fill_the_rest(spark):
    rows = [(i, "w " * (400 if i % 10 == 0 else 1 + i % 7), "s" if i % 2 else "t") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in (0, 1):
        mine = [r for r in got if r["doc_id"] % 2 == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 8


def test_mix(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = {d: len(WORD.findall(t or "")) for d, t, *_ in rows}
    assert {d: r["size"] for d, r in got.items()} == size
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got.values())
    for s in {r[3] for r in rows}:
        mine = [got[d] for d, _, _, x, _ in rows if x == s]
        assert {r["source_size"] for r in mine} == {sum(r["size"] for r in mine)}
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {d: r["taken"] for d, r in got.items()}
    assert mixing.mix(empty).count() == 0
    both = docs.withColumn("source", F.array(F.lit("a"), F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a")))
    assert sum(r["taken"] for r in mixing.mix(both).collect()) == pytest.approx(sum(size.values()), rel=0.2)


def test_selection_is_that_of_one_pass_in_hash_order(spark, small):
    docs = read(spark, small, "documents").select("doc_id", "text", "source")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    order = docs.select("doc_id", "source", F.xxhash64(F.lit(1), F.col("doc_id")).alias("h"), F.xxhash64(F.lit(~1), F.col("doc_id")).alias("k")).collect()
    for source in {r["source"] for r in order}:
        mine = sorted((r["h"], r["k"], got[r["doc_id"]]["size"], r["doc_id"]) for r in order if r["source"] == source)
        total, target = sum(x[2] for x in mine), round(got[mine[0][3]]["target"])
        rounds, left = divmod(target, total) if total else (0, 0)
        if rounds == 3:
            left = 0
        most, seen, stretch, taken = left, 0, 0, set()
        for _, _, size, doc in mine:
            if not size or size > most or stretch == mixing.STRETCHES:
                continue
            if seen + size > most:
                most, seen, stretch = most - seen, 0, stretch + 1
                continue
            seen += size
            taken.add(doc)
        rest = left - sum(size for _, _, size, doc in mine if doc in taken)
        last = min(((abs(size - rest), h, k, size, doc) for h, k, size, doc in mine if doc not in taken and 0 < size < 2 * rest), default=None)
        if last and rest > 0:
            taken.add(last[-1])
        assert {d: got[d]["copies"] for _, _, _, d in mine} == {d: (rounds + (d in taken)) * (size > 0) for _, _, size, d in mine}


def test_many_patterns_are_routed_in_little_time():
    r = random.Random(1)
    sources = [f"s{i:02}" for i in range(40)]
    patterns = {}
    while len(patterns) < 100_000:
        patterns[tuple(sorted(r.sample(sources, r.randint(1, 4))))] = r.randint(0, 500)
    total = sum(patterns.values())
    targets = {s: total / 40 * r.uniform(0.2, 2.2) for s in sources}
    targets = {s: t * total / sum(targets.values()) for s, t in targets.items()}
    began = time.time()
    flow = mixing.route(patterns, targets)
    assert time.time() - began < 60
    by_source, by_pattern = Counter(), Counter()
    for (p, s), n in flow.items():
        assert s in p and n > 0
        by_source[s] += n
        by_pattern[p] += n
    assert all(by_pattern[p] <= 3 * n for p, n in patterns.items()) and by_source == {s: round(t) for s, t in targets.items()}


def test_feistel():
    for n in (1, 2, 3, 1000, 4096):
        assert sorted(token_output.Feistel(n, 7).slots(np.arange(n)).tolist()) == list(range(n))
    assert (token_output.Feistel(1000, 7).slots(np.arange(1000)) != token_output.Feistel(1000, 8).slots(np.arange(1000))).any()


def test_encoder_is_the_tokenizer(rows):
    enc = token_output.encoder(token_output.TOKENIZER)
    for _, t, *_ in [*rows, (0, "a b.\nc  d e, f! (g) h2 \n i"), (0, " lead"), (0, "trail ")]:
        for _ in range(2):
            assert enc.encode(t or "") == np.array(enc.call(t or ""), dtype="<u2").tobytes()


def test_shards_round_trip(spark, docs, rows, empty, tmp_path):
    options = {"seq_len": 32, "shard_slots": 16}
    seqs = token_output.sequences(docs, **options).persist()
    path = f"file://{tmp_path}/shards"
    for _ in range(2):  # a second run leaves the same bytes
        written = token_output.write_shards(seqs, path, 16).collect()
    assert sum(r["n_records"] for r in written) == seqs.count() and all(r["n_bytes"] == r["n_records"] * 64 for r in written)
    table = {r["slot"]: r for r in seqs.collect()}
    assert sorted(table) == list(range(len(table)))
    assert [x.tobytes() for x in token_output.read_slots(path, 5, len(table) - 5, 32, 16)] == [bytes(table[s]["record"]) for s in range(5, len(table))]
    enc = token_output.encoder(token_output.TOKENIZER)
    parts = {}
    for r in table.values():
        parts.setdefault(r["doc_id"], {})[r["seq_no"]] = bytes(r["record"])[: 2 * r["n_tokens"]]
    for d, t, *_ in rows:
        ids = np.frombuffer(b"".join(parts[d][i] for i in range(len(parts[d]))), dtype="<u2")
        assert ids[-1] == enc.end and ids[:-1].tolist() == list(enc.call(t or ""))
    order = lambda df: sorted((r["slot"], r["doc_id"], r["seq_no"], r["record_sha256"]) for r in token_output.digests(df, **options).collect())
    assert order(docs) == order(docs.repartition(2)) == sorted((s, r["doc_id"], r["seq_no"], hashlib.sha256(bytes(r["record"])).hexdigest()) for s, r in table.items())
    assert token_output.digests(empty).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline as p

    from .test_dedup import classes

    docs = read(spark, small, "documents")
    columns, before = docs.columns, None
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, p.materialize(stage(spark, docs, small), "test")
        assert docs.columns == columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        was = {r["doc_id"]: r for r in before.collect()}
        assert ids <= set(was)
        if name == "ngram_join":
            want = classes([(d, r["text"]) for d, r in was.items()])
            assert ids == {c for _, c in want.values()}
        if name == "mixing":
            taken = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {d: c for d, c in taken.items() if c}
    assert p.STAGES[-1][1](spark, docs, small).count() >= docs.count()
    assert p.run(spark, small).count() > 0


def test_pipeline_on_odd_rows(spark, docs, empty, small):
    import corpus_pipeline as p

    for some in (docs, empty):
        out = some
        for _, stage in p.STAGES:
            out = p.materialize(stage(spark, out, small), "odd")
        out.count()


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert [n for i in range(1, 11) for n in names if n.startswith(f"op{i}_")].__len__() == 10 and "pipeline" in names and set(e.oracle_sql()) <= set(names)
