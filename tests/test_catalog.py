import duckdb
import pytest

from spanwarden import catalog

TABLES = "documents pages conversations customer orders part nation events".split()


def same(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, sf_dir), con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    rows = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    assert rows == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
    return rows


@pytest.mark.parametrize("name", ["structure_extract", "field_types", "cascade_parse", "library_category", "pii_classified", "framework_details", "judged_sections", "judged_findings", "tree_rules", "taint_flows", "dependency_rules", "lexed_bodies", "routes_of_code", "erasure_section", "consent_section", "children_status", "authorised_requests", "all_matches"])
def test_queries_over_the_tree_agree_with_their_sql(spark, small, name):
    assert same(spark, small, name)


def test_long_bodies_are_read_whole(spark):
    from pyspark.sql import functions as F

    from spanwarden.operators import structure

    many = "\n".join(f"  String f{i}x;".replace("String", "private String") for i in range(3000))
    js = "function transfer(a) {\n" + "  step();\n" * 500 + "  audit(a);\n}\nfunction refund(a) {\n  go();\n}\n"
    files = spark.createDataFrame([("A.java", "@Entity\npublic class A {\n" + many + "\n}\n"), ("deep.py", "x = " + "(" * 5000 + ")" * 5000), ("m.js", js)], "file_path string, content string")
    rows = structure.extract(files)
    assert rows.filter("kind = 'field'").agg(F.count("*"), F.max("line")).first()[:] == (3000, 3002)
    assert rows.filter("kind = 'error'").count() == 1
    got = structure.unaudited_functions(files, "p/x", "transfer|refund", "audit").collect()
    assert [(r["name"], r["line_start"]) for r in got] == [("refund", 504)]


def test_names_are_titled_as_associations_are(spark):
    from pyspark.sql import functions as F

    from spanwarden.operators import structure

    df = spark.createDataFrame([("order_items",), ("boss",), ("x2y",), ("älteste",)], "n string")
    assert [r[0] for r in df.select(structure.associated_model(F.col("n"))).collect()] == [n.rstrip("s").title() for n in ("order_items", "boss", "x2y", "älteste")]


def test_categories_ignore_case_and_take_the_first_entry(spark):
    from pyspark.sql import functions as F

    from spanwarden.operators import structure

    df = spark.createDataFrame([("CRYPTO.hash",), ("jwt",), ("django-auditlog",), ("requests",), ("logging.handlers",), ("jwtx",)], "n string")
    assert [r[0] for r in df.select(structure.security_category(F.col("n"))).collect()] == ["encryption", "auth", "logging", None, "logging", None]
