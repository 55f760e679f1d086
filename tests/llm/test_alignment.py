"""Token alignment against the tokenizers on whole texts and groups by union of overlaps."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwarden.llm import token_align
from spanwarden.llm.common import read

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_align.TOKENIZER_A)
    a.encode_special_tokens = True
    symbols = token_align.byte_symbols()
    with open(token_align.TOKENIZER_A, encoding="utf-8") as f:
        entries = {i: bytes(symbols[c] for c in e) for e, i in json.load(f)["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=token_align.TOKENIZER_B)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda t: ([(i, entries[i]) for i in a.encode(" " + t, add_special_tokens=False).ids], [(i, piece(i)) for i in b.encode(t)])


def brute(rows, both):
    """One token after the other: groups end where the bytes of both sides do."""
    done, links = [], Counter()
    for d, t in rows:
        a, b = both(t) if t else ([], [])
        if not t or b"".join(x for _, x in a) != (" " + t).encode() or b"".join(x for _, x in b) != (" " + t).encode():
            done.append((d, 0, 0, [], []))
            continue
        ends = lambda side: [sum(len(x) for _, x in side[: i + 1]) for i in range(len(side))] if len(side) < 300 else np.cumsum([len(x) for _, x in side]).tolist()
        ea, eb = ends(a), ends(b)
        cuts = sorted(set(ea) & set(eb))
        groups, i, j, pairs = [], 0, 0, []
        for cut in cuts:
            x, y = ea.index(cut, i) + 1, eb.index(cut, j) + 1
            groups.append(f"{','.join(str(k) for k, _ in a[i:x])}|{','.join(str(k) for k, _ in b[j:y])}")
            pairs.append((a[x - 1][0], b[y - 1][0]))
            i, j = x, y
        links.update(pairs)
        done.append((d, len(a), len(b), groups, pairs))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((d, na, nb, len(g), len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), ";".join(g)) for d, na, nb, g, p in done)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


TEXTS = [
    "Hello world, it's  a   test.", "", None, " ", "  ", "a", "tab\t z ", "trailing ", "line\nline\n\n two\r\n", "<|endoftext|> <s> </s> <unk> <0x0A> <pad>", "▁ is not a space", "x▁y", "nul\x00 in it",
    "éè üß 漢字 \U0001f600\U0001f468‍\U0001f469 é", " nbsp  q   em", "\x85 \x1c x \x1f y", "don't we'll I'd 'tis 's", "1234 56,789.00 $5", "_" * 700, "aaaa " * 300, "العربية हिन्दी", "﻿bom   sep", "á ́b", "ẞɐǅ Ͱ",
]


@pytest.mark.parametrize("options", [{}, {"round_pairs": 40}])
def test_alignment_is_that_of_whole_texts(spark, both, options, monkeypatch):
    monkeypatch.setattr(token_align, "MEMO_PIECES", 20)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "again"), (77, TEXTS[0]), (77, TEXTS[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pair": F.lit(1), "packed": F.lit("x"), "n_best": F.lit(2), "groups": F.lit("g")}).repartition(3)
    got = result(token_align.align_corpus(df, **options))
    assert got == brute(rows, both)
    assert [r for r in got if r[0] == 10][0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_the_documents_and_digests(spark, small, both):
    docs = read(spark, small, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, both)
    assert result(token_align.align_corpus(docs)) == want
    from spanwarden.llm.queries import op13_token_align

    got = {r["doc_id"]: r["groups_sha256"] for r in op13_token_align(spark, small).collect()}
    assert got == {r[0]: hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "" for r in want}


def test_alignment_of_no_rows_null_ids_and_long_texts(spark, empty, both):
    assert token_align.align_corpus(empty).count() == 0
    df = spark.createDataFrame([(None, "no id"), (None, None)], "doc_id long, text string")
    assert sorted((r["n_a"], r["doc_id"]) for r in token_align.align_corpus(df).collect()) == [(0, None), (2, None)]
    long = "some words, and more of them. " * 400_000
    got = token_align.align_corpus(spark.createDataFrame([(1, long)], "doc_id long, text string"), keep_groups=False).first()
    one = brute([(1, "some words, and more of them. " * 2)], both)[0]
    two = brute([(1, "some words, and more of them. " * 3)], both)[0]
    assert got["n_a"] == one[1] + 399_998 * (two[1] - one[1])


def test_pointer_jumping_labels_components_of_overlaps():
    r = np.random.RandomState(7)
    for _ in range(200):
        n = r.randint(1, 60)
        a, b = (np.unique(np.append(r.randint(1, n + 1, r.randint(0, n + 1)), n)) for _ in range(2))
        ga, gb = token_align.components(a, b)
        cuts = np.intersect1d(a, b)
        assert (ga == np.searchsorted(cuts, a)).all() and (gb == np.searchsorted(cuts, b)).all()
