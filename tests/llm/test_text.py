import zlib

import pytest
from pyspark.sql import functions as F

from spanwarden.llm import decontamination, html_extract, language_id
from spanwarden.llm.common import read


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""), ("", ""), ("<p>a&amp;b &eacute;\n  c", "a&b é c"),
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><header>Site</header><article><h1>T</h1><p><b>One<br><p>Two.</p><script>var x='</p>';</script><div class=\"share\">Share</div><p>Three <a href=y>link</a>.</p><section id=comments><p>nice!</p></section></article><aside>side</aside><footer>&copy; us</footer></body></html>", "T\n\nOne\n\nTwo.\n\nThree link."),
        ("<body><div class=menu><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div class=cookie-notice>We use cookies</div><div id=content><p>" + "word " * 60 + "</p><p>Short.</p><p>" + "more " * 60 + "</p></div><form><label>Mail</label><input></form><div class='ad'>Buy!</div></body>", ("word " * 60).strip() + "\n\nShort.\n\n" + ("more " * 60).strip()),
        ("<div><p>one</div></span></p><p>two</p>", "one\n\ntwo"),
    ],
)
def test_pages(html, want):
    assert html_extract.extract_text(html) == want


@pytest.mark.parametrize("html,want", [
    ("<![foo[bar]]>x", "x"), ("a<!-- x", "a"), ('<p>one</p><b title="x>two</b><p>three</p>', "one\n\ntwo\n\nthree"), ("<p>a < b</p><![CDATA[z]]>", "a < b"), ("<p>x</p><scr", "x"), ("<p>5 &lt 6 &am", "5 < 6 &am"), ("<" * 50 + "p", None),
])
def test_faulty_markup_is_not_text(html, want):
    got = html_extract.extract_text(html)
    assert want is None or got == want


def test_ratios_choose_where_nothing_is_named(monkeypatch):
    links = lambda k: "".join(f'<div><a href="/{k}{i}">Topic {k} {i}</a></div>' for i in range(12))
    said = [f"Sentence number {i} of a report that runs on for quite some time, with clauses, and an end." for i in range(9)]
    teasers = "".join(f"<div><span><b>{i}</b></span><i>More</i><i>soon</i></div>" for i in range(8))
    text = "<h2>The report</h2>" + "".join(f"<div>{s}</div>" for s in said[:5]) + "<div>Short.</div>" + "".join(f"<div>{s}</div>" for s in said[5:])
    page = f"<body><div>{links('a')}</div><div>{text}</div><div>{teasers}</div><div>{links('b')}</div></body>"
    want = "\n\n".join(["The report", *said[:5], "Short.", *said[5:]])
    assert html_extract.extract_text(page) == want
    flat = page.replace("<body><div>", "<body>").replace("</div></body>", "</body>").replace("</div><div><h2>", "<h2>").replace("</div><div><div>", "<div>")
    assert html_extract.extract_text(flat) == want
    monkeypatch.setattr(html_extract, "smooth", lambda values: [1.0] * len(values))
    assert html_extract.extract_text(flat) != want


def test_page_table(spark, small):
    import html as h
    import re

    pages = read(spark, small, "pages")
    truth = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        truth[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    got = html_extract.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == truth and all(r["n_chars"] == len(r["text"]) for r in got)
    odd = spark.createDataFrame([(1, None, None), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_extract.extract(odd).collect()) == ["", "x"]
    assert html_extract.extract(odd.filter("false")).count() == 0


def test_language(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(docs).join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_ignores_labels_of_held_out_rows(spark, small):
    docs = read(spark, small, "documents")
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: r["lang_pred"] for r in language_id.identify(d).collect()} for d in (docs, wrong))
    assert a == b


def test_language_edges(docs, empty):
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    for d, t in ((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()):
        if t is None or not any(c.isalpha() for c in t):
            assert (got[d]["lang_pred"], got[d]["score"], got[d]["rejected"]) == ("und", 0.0, True)
        else:
            assert got[d]["lang_pred"] in ("en", "de")
    assert language_id.identify(empty).count() == 0


def test_decontamination(spark, small):
    docs, items = read(spark, small, "documents"), read(spark, small, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, items).collect()}
    plain = lambda t: " ".join(x for w in t.lower().split() if (x := w.strip(".,!#$%&|")))
    truth = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if plain(i["text"]) in plain(d["text"])}
    assert got == truth and truth
    assert {r["doc_id"] for r in decontamination.clean(docs, items).collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in truth}


def test_templates(spark, empty):
    item = spark.createDataFrame([(1, "Alice Smith bought 5 kg of apples and gave 12 apples to Bob before she counted all the rest again in the evening."), (2, None), (3, "too short")], "item_id long, text string")
    said = [
        (1, "Well: Maria Jones bought 7 lb of apples and gave 31 apples to Peter before she counted all the rest again in the evening."),
        (2, "ALICE SMITH BOUGHT 5 KG OF APPLES AND GAVE 12 APPLES TO BOB BEFORE SHE COUNTED ALL THE REST AGAIN IN THE EVENING."),
        (3, "Maria bought 7 lb of pears and then went home to count what she had left of them"), (4, None), (None, "Alice Smith bought 5 kg of apples and gave 12 apples to Bob before she counted all the rest again in the evening."), (5, "too short"), (6, "one line\nToo short!\r\nand more"), (7, "this line is too short for that"),
    ]
    got = decontamination.matches(spark.createDataFrame(said, "doc_id long, text string"), item).collect()
    assert {(r["doc_id"], r["item_id"], r["slot_agreement"]) for r in got} == {(1, 1, 1.0), (2, 1, 1.0), (5, 3, 1.0), (6, 3, 1.0)}
    assert decontamination.matches(empty, item).count() == 0
    assert decontamination.matches(spark.createDataFrame(said, "doc_id long, text string"), item.filter("false")).count() == 0


def test_pages_with_clashing_columns_and_a_very_long_page(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} says a few words.</p>" for i in range(40_000)) + "</article>"
    rows = [(1, "u", long, "x", 5), (1, "u", "<p>y", "x", None), (None, None, "<p>z", None, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r["n_chars"], r["text"][:11]) for r in html_extract.extract(df).collect())
    assert got == [(1, "y"), (1, "z"), (sum(len(f"Paragraph {i} says a few words.") + 2 for i in range(40_000)) - 2, "Paragraph 0")]


def test_contaminated_documents_with_clashing_columns(spark):
    text = "Alice Smith bought 5 kg of apples and gave 12 apples to Bob before she counted all the rest again in the evening."
    rows = [(1, text, 7, "k", ["w"]), (2, "nothing of the kind", 8, None, None), (1, text, 9, "k", None), (None, text, 1, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id long, key string, words array<string>")
    items = spark.createDataFrame([(3, text, "x"), (4, text, "y")], "item_id long, text string, doc_id string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(df, items).collect()} == {(1, 3), (1, 4)}
    kept = decontamination.clean(df, items)
    assert kept.columns == df.columns and sorted(str(r["item_id"]) for r in kept.collect()) == ["1", "8"]


def test_languages_tie_by_name(spark):
    rows = [(i, f"same words here {i % 4}", "b" if i % 2 else "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionary = {"b": b"same words here", "a": b"same words here"}
    assert {r["lang_pred"] for r in language_id.classify(df, dictionary).collect()} == {"a"}
    assert {r["margin"] for r in language_id.classify(df, dictionary).collect()} == {0.0}
