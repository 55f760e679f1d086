import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwarden.llm import lm_score
from spanwarden.llm.common import read


def test_lm_scores(docs, rows, empty):
    got = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    tokens = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t, *_ in rows}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(w in counts for w in ws), n, zlib.crc32(str(d).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r["score"] < 0 and r["doc_id"] == d and r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))
    assert lm_score.score(empty).count() == 0


def test_lm_without_training_rows(spark):
    df = spark.createDataFrame([(10, "a b"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.score(df, held=F.lit(True)).collect()}
    assert got[10]["score"] == pytest.approx(0.0, abs=1e-6) and got[None]["n_tokens"] == 1 and got[10]["train_tokens"] == 0


def test_lm_agrees_with_itself(spark):
    texts = [(i, f"{a} {b}") for i, (a, b) in enumerate([("ab", "ba"), ("ab", "abba"), ("cab", "ab"), ("ba", "zz")] * 8)]
    df = spark.createDataFrame([*texts, (1000, "ab"), (1001, "ab abba"), (1002, "ab unseen"), (1003, "")], "doc_id long, text string")
    score = lambda d: {r["doc_id"]: r["score"] for r in lm_score.score(d, held=F.col("doc_id") >= 1000).collect()}
    one = score(df)
    assert one == score(df.repartition(3)) and one[1001] > one[1002] and one[1000] > one[1002] and one[1003] < 0


def test_lm_order_of_words_counts_and_held_out_rows_beat_the_base(spark, small):
    docs = read(spark, small, "documents").select("doc_id", "text")
    long = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).filter(F.length("text") > 400)
    shuffled = long.select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.array_join(F.reverse(F.split("text", r"\s+")), " ").alias("text"))
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0) | (F.col("doc_id") >= 10_000_000)
    got = {r["doc_id"]: r for r in lm_score.score(docs.unionByName(shuffled), held=held).collect()}
    ids = [r["doc_id"] for r in long.collect()]
    pairs = [(got[i]["score"], got[i + 10_000_000]["score"]) for i in ids]
    assert sum(a != b for a, b in pairs) > 0.9 * len(pairs) > 0 and sum(a for a, _ in pairs) > sum(b for _, b in pairs)
    own = [r for r in got.values() if r["held_out"] and r["doc_id"] < 10_000_000]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


class Sampler:
    """Brute force: every customer and table by itself, one customer removed and reseated at a time."""

    def __init__(self, pairs, kinds, d, d0, theta=1.0, seed=3):
        self.r, self.base, self.d, self.d0, self.theta = random.Random(seed), 1 / (kinds + 1), d, d0, theta
        self.rooms, self.top = defaultdict(lambda: defaultdict(list)), defaultdict(list)
        self.pairs = list(pairs)
        for u, w in self.pairs:
            self._add(u, w)

    def p_top(self, w):
        c = sum(map(sum, self.top.values()))
        t = sum(map(len, self.top.values()))
        return (sum(self.top[w]) - self.d0 * len(self.top[w]) + (self.theta + self.d0 * t) * self.base) / (self.theta + c)

    def p(self, u, w):
        room = self.rooms[u]
        c, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        return (sum(room[w]) - self.d * len(room[w]) + (self.theta + self.d * t) * self.p_top(w)) / (self.theta + c)

    def _sit(self, tables, d, new):
        weights = [n - d for n in tables] + [new]
        at = self.r.choices(range(len(weights)), weights)[0]
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return at == len(tables) - 1 and tables[at] == 1

    def _add(self, u, w):
        t = sum(map(len, self.rooms[u].values()))
        if self._sit(self.rooms[u][w], self.d, (self.theta + self.d * t) * self.p_top(w)):
            t0 = sum(map(len, self.top.values()))
            self._sit(self.top[w], self.d0, (self.theta + self.d0 * t0) * self.base)

    def _leave(self, tables):
        at = self.r.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            return True
        return False

    def sweep(self):
        for u, w in self.pairs:
            if self._leave(self.rooms[u][w]):
                self._leave(self.top[w])
            self._add(u, w)


def test_lm_agrees_with_a_brute_force_sampler(spark, monkeypatch):
    r = random.Random(11)
    texts = [" ".join(r.choice("aaaabbbccd") for _ in range(r.randint(3, 12))) for _ in range(60)]
    stream = [("\n" if i == 0 else (ws := [*t.split(), "\n"])[i - 1], w) for t in texts for i, w in enumerate([*t.split(), "\n"])]
    counts = Counter(stream)
    n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
    contexts = Counter(w for _, w in counts)
    m1, m2 = sum(c == 1 for c in contexts.values()), sum(c == 2 for c in contexts.values())
    d0 = min(0.95, max(0.1, m1 / max(1, m1 + 2 * m2)))
    brute = Sampler(stream, len(contexts), d, d0)
    known, total, n = sorted(contexts), Counter(), 0
    for s in range(150):
        brute.sweep()
        if s >= 30:
            n += 1
            total.update({(u, w): brute.p(u, w) for u in known for w in [*known, "?"]})
    monkeypatch.setattr(lm_score, "SWEEPS", 14)
    monkeypatch.setattr(lm_score, "BURN_IN", 4)
    probes = [(1000 + i, f"{u} {w}") for i, (u, w) in enumerate((u, w) for u in known if u != "\n" for w in [*(k for k in known if k != "\n"), "?"])]
    df = spark.createDataFrame([*enumerate(texts), *probes], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, held=F.col("doc_id") >= 1000).collect()}
    p = lambda u, w: math.log10(total[u, w] / n)
    for i, t in probes:
        u, w = t.split()
        if w in contexts:
            assert got[i] == pytest.approx(p("\n", u) + p(u, w) + p(w, "\n"), abs=0.06), t


@pytest.mark.parametrize("count,base", [(2, 0.5), (7, 0.3), (300, 0.05), (1000, 0.4), (3000, 0.4), (3000, 0.02)])
def test_lm_seats_have_their_conditional_law(count, base):
    """The number of tables against the exact law: generalised Stirling numbers times the weights of new tables."""
    theta, d, rest, n = 1.0, 0.4, 6.0, 400
    most = min(count, 600)
    row = np.full(most + 2, -np.inf)
    row[1] = 0.0
    for m in range(1, count):  # S(m + 1, t) = S(m, t - 1) + (m - d t) S(m, t)
        t = np.arange(1, most + 2)
        stay = np.log(np.maximum(m - d * t, 1e-300)) + row[1:]
        row[1:] = np.where(t <= m + 1, np.logaddexp(stay, row[:-1]), -np.inf)
    t = np.arange(1, most + 1)
    log = row[1:-1] + np.cumsum(np.log((theta + d * (rest + t - 1)) * base))
    law = np.exp(log - log.max())
    law /= law.sum()
    mean, spread = (law * t).sum(), math.sqrt((law * t**2).sum() - (law * t).sum() ** 2)
    counts, key = np.full(n, count), np.arange(n, dtype=np.uint64)
    weight = lambda i, k: (theta + d * (rest + k - 1)) * base + 0.0 * i
    log_new = lambda i, k: lm_score._rising(theta / d + rest + 1 + 0.0 * i, k - 1) + (k - 1) * np.log(d * base)
    tables, seen = np.ones(n), []
    for s in range(30):
        tables = lm_score.draw_tables(counts, tables, weight, log_new, d, key, s + 1, s == 0)
        if s >= 5:
            seen.append(tables)
    seen = np.concatenate(seen)
    assert seen.mean() == pytest.approx(mean, rel=0.03) and seen.std() == pytest.approx(spread, rel=0.1)


def test_lm_scores_do_not_depend_on_how_rows_are_read(spark, small):
    """One file read by two branches of a plan, dealt anew or read plainly: equal rows."""
    docs = read(spark, small, "documents").select("doc_id", "text")
    rows = lambda df: {r["doc_id"]: r for r in lm_score.score(df).collect()}
    plain = rows(docs)
    for other in (docs.filter("doc_id < 60").unionByName(docs.filter("doc_id >= 60")), docs.repartition(4)):
        got = rows(other)
        assert got.keys() == plain.keys()
        for d, r in plain.items():
            assert (got[d]["n_known"], got[d]["n_tokens"]) == (r["n_known"], r["n_tokens"])
            assert got[d]["base_score"] == pytest.approx(r["base_score"], rel=1e-9) and got[d]["score"] == pytest.approx(r["score"], rel=1e-6)


def test_lm_raises_where_answers_are_missing(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b c a") for i in range(20)], "doc_id long, text string")
    whole = lm_score._answer
    monkeypatch.setattr(lm_score, "_answer", lambda *a: whole(*a).filter("kind = 0"))
    with pytest.raises(Exception, match="answers for"):
        lm_score.score(df).collect()


def test_sweeps_are_dropped_before_some_are_averaged():
    assert lm_score.BURN_IN >= 1 and lm_score.SWEEPS - lm_score.BURN_IN >= 2


def test_packed_hashes_take_little_more_than_their_own_bits():
    """Steps of sorted hashes have zeros in their high bytes; what is packed comes back as it was."""
    keys = np.sort(np.random.RandomState(1).randint(0, 1 << 62, 10_000, dtype=np.uint64))
    piece = lm_score.pack(lm_score._steps(keys))
    assert len(piece) < 6.8 * len(keys)
    assert (lm_score._keys(lm_score.unpack(piece, np.uint8)[0]) == keys).all()
    assert len(lm_score._keys(lm_score._steps(keys[:0]))) == 0


def test_chunks_meet_their_answers_in_turns(spark, small, monkeypatch):
    docs = read(spark, small, "documents").select("doc_id", "text").repartition(16)
    meet, met = lm_score._meet, []
    monkeypatch.setattr(lm_score, "_meet", lambda chunks, answers, *more: met.append(({r[0] for r in chunks.select("chunk").collect()}, {r[0] for r in answers.select("chunk").collect()})) or meet(chunks, answers, *more))
    rows = lambda: sorted(map(str, lm_score.score(docs).collect()))
    turns = rows()
    assert len(met) == lm_score.TURNS > 1 and all(chunks == told for chunks, told in met)
    every = set().union(*(chunks for chunks, _ in met))
    assert sum(len(chunks) for chunks, _ in met) == len(every) == 16 > max(len(chunks) for chunks, _ in met)
    monkeypatch.setattr(lm_score, "TURNS", 1)
    assert rows() == turns and met[-1][0].isdisjoint(every)


def test_sweeps_shuffle_pieces_not_rows_of_pairs(spark, monkeypatch):
    """Each sweep wrote and shuffled a row a pair seen more than once, and a row a word."""
    r = random.Random(5)
    ws = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(r.choice(ws) for _ in range(400))) for i in range(100)], "doc_id long, text string").repartition(2)
    rows = []

    def counted(make):
        def run(df, name, *more):
            out = make(df, name, *more)
            rows.append((name, sum(x.count() for x in (out if isinstance(out, list) else [out]))))
            return out

        return run

    monkeypatch.setattr(lm_score, "materialize", counted(lm_score.materialize))
    if hasattr(lm_score, "materialize_by"):
        monkeypatch.setattr(lm_score, "materialize_by", counted(lm_score.materialize_by))
    scores = lambda: {x["doc_id"]: x["score"] for x in lm_score.score(df).collect()}
    one = scores()
    assert sum(n for name, n in rows if name != "lm-scores") < 100
    monkeypatch.setattr(lm_score, "GROUP_TOKENS", 2500)  # some 15 groups, words of more than 312 tokens dealt by pair: none here
    monkeypatch.setattr(lm_score, "HOT", 10)
    assert scores() == pytest.approx(one, rel=1e-6)


def test_pairs_of_very_frequent_words_are_dealt_over_all_groups(spark, monkeypatch):
    """One word ends most pairs: many small groups have the rows of one group."""
    r = random.Random(6)
    texts = [(i, " ".join(x for _ in range(100) for x in (f"w{r.randint(0, 150)}", "the"))) for i in range(100)]
    df = spark.createDataFrame([*texts, (1000, "the w1 the unseen"), (1001, "")], "doc_id long, text string")
    rows = lambda: {x["doc_id"]: x for x in lm_score.score(df).collect()}
    deal, one = lm_score._count_pairs, rows()
    dealt = []

    def count_pairs(chunks, hot, wide, buckets, groups):
        dealt.append((groups, len(wide.value)))
        return deal(chunks, hot, wide, buckets, groups)

    monkeypatch.setattr(lm_score, "_count_pairs", count_pairs)
    monkeypatch.setattr(lm_score, "GROUP_TOKENS", 1000)
    many = rows()
    assert dealt[0][0] > 15 and dealt[0][1] >= 1 and many.keys() == one.keys()
    for d, x in one.items():
        assert (many[d]["n_known"], many[d]["n_tokens"]) == (x["n_known"], x["n_tokens"])
        assert many[d]["base_score"] == pytest.approx(x["base_score"]) and many[d]["score"] == pytest.approx(x["score"], rel=1e-6)
