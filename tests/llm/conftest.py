import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=5, n=70):
    """Texts with copies, near copies, shared passages, hot passages, nulls, empty, short, long and odd ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)]
    said = lambda k: [r.choice(vocabulary) for _ in range(k)]
    hot, texts = said(30), []
    base = said(90)
    for i in range(n):
        words = said(r.choice([0, 1, 3, 8, 40, 120]))
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = hot
        if i % 5 == 0:
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    texts += [texts[1], texts[3], texts[3].upper(), None, None, "", "é ß 漢字 " * 60, "a" * 500, "x y " * 150, "\x85\xa0 q", "\t\n "]
    ids = list(range(0, 3 * len(texts), 3))
    r.shuffle(ids)
    return [(d, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None]), len(t or "")) for d, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    # extra columns with names that the operators use inside; many small partitions
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("extra").alias(c) for c in ("key", "n", "size", "words", "spans", "h", "gram", "rejected", "score", "chunk", "copies", "target", "text_sha256")]).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
