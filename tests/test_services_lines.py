"""The code base made of documents: texts keep their spaces, lines are counted by characters."""

from spanwarden import catalog
from spanwarden.operators import privacy, structure
from spanwarden.sources import services


def test_only_line_ends_break_texts(spark):
    docs = spark.createDataFrame([(12, "a child  of ten\u0085or  \r\n so")], "doc_id long, text string")
    [row] = services.documents_as_services(docs).collect()
    assert row["content"].endswith("\n# a child  of\n# ten\n# or  \n#  so")


def test_lines_behind_characters_of_two_halves(spark):
    files = spark.createDataFrame([("a.py", "\U0001f600" * 9 + "\nbreach\n\n\n\n\n\n"), ("b.py", "nothing")], "file_path string, content string")
    assert [tuple(r) for r in privacy.evidence(files, {"breach": privacy.BREACH, "mail": privacy.NOTIFICATION}).collect()] == [("a.py", "2: breach", None)]
    files = spark.createDataFrame([("a.js", "// " + "\U0001f600" * 9 + "\nconst b = require('bcrypt')\n\n\n\n\n\n")], "file_path string, content string")
    assert [(r["module"], r["line"]) for r in structure.import_patterns(files).collect()] == [("bcrypt", 2)]


def test_names_that_share_their_pieces(spark):
    views = spark.createDataFrame([("PERSON12View",), ("xPerson1",), ("",), (None,)], "view string")
    names = spark.createDataFrame([("Person1",), ("person12",), ("View",), ("",)], "model string")
    got = sorted((r["view"], r["model"]) for r in privacy.named_in(views, "view", names, "model").collect())
    assert got == [("PERSON12View", "Person1"), ("PERSON12View", "View"), ("PERSON12View", "person12"), ("xPerson1", "Person1")]


def test_all_sections_that_need_a_judgement(spark, small):
    assert [r["section"] for r in catalog.queries()["judged_sections"](spark, small).collect()] == ["§4", "§5", "§7(3)"]
