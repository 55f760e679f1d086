from spanwarden.operators import structure


def test_long_files(spark):
    py = "# filler\n" * 70_000 + "import bcrypt\n"
    js = "function refund(a) {\n" + "  step(a);\n" * 300 + "  audit(a);\n}\n"
    bare = "function refund(a) {\n  step(a);\n}\n"
    files = spark.createDataFrame([("long.py", py), ("long.js", js), ("bare.js", bare)], "file_path string, content string")
    assert [r["name"] for r in structure.extract(files).filter("file = 'long.py' AND kind = 'import'").collect()] == ["bcrypt"]
    assert [r["file_path"] for r in structure.unaudited_functions(files, "p/x", "refund", "audit").collect()] == ["bare.js"]
