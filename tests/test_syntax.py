"""Node tables, tree patterns, flows of values, versions and lexical states."""

import random

import pytest
from pyspark.sql import functions as F

from spanwarden.operators import dependencies, lexis, rules, structure, syntax, taint

QUERY = "(function_definition name: (identifier) @fn_name body: (block) @fn_body)"


def pack(*given, **more):
    made = [rules._rule({"id": f"r{i}", "name": "n", "severity": "HIGH", "message": "{file}:{line}", "languages": ["python"], "type": "ast"} | g, "here") for i, g in enumerate(given)]
    return rules.Pack("t/p", "1", "t", tuple(made))


def found(spark, files, *given):
    out = syntax.scan_trees(spark.createDataFrame(list(files.items()), "file_path string, content string"), [pack(*given)])
    return [] if out is None else sorted((r["rule_id"][4:], r["file_path"], r["line_start"], r["col_start"], r["col_end"], r["snippet"]) for r in out.collect())


CODE = '''@app.route("/x")
async def transfer(a: int, *b):
    """Moves é."""
    é = f(1); return pickle.loads(a)


class Desk(Base):
    def credit(self):
        if self.ok:
            audit_log(self)
        def inner(): pass
        return None
'''


def test_captures_names_and_bodies(spark):
    both = {"query": QUERY, "name_regex": "(?i)transfer|credit|inner"}
    assert found(spark, {"a.py": CODE}, both) == [("r0", "a.py", 2, 11, 19, "async def transfer(a: int, *b):"), ("r0", "a.py", 8, 9, 15, "def credit(self):"), ("r0", "a.py", 11, 13, 18, "def inner(): pass")]
    assert [x[2] for x in found(spark, {"a.py": CODE}, both | {"must_not_contain": "audit_log"})] == [2, 11]
    assert found(spark, {"a.py": CODE}, {"query": "(function_definition name: (identifier) @fn_name)", "enabled": False}) == []
    assert found(spark, {"a.js": CODE, "a.go": CODE, "b.py": "def broken(:"}, {"query": QUERY}) == []


@pytest.mark.parametrize("query,lines", [
    ("(block . (expression_statement (string)) @doc)", [3]),
    ("(block (return_statement) @r .)", [4, 12]),
    ("(class_definition name: (identifier) @fn_name superclasses: (argument_list . (identifier) @base .))", [7]),
    ('(call function: (attribute object: (identifier) @o attribute: (identifier) @fn_name) (#eq? @o "pickle") (#match? @fn_name "^loads?$"))', [4]),
    ('((call function: (identifier) @fn_name) (#any-of? @fn_name "f" "audit_log"))', [4, 10]),
    ('(call function: (identifier) @fn_name (#not-match? @fn_name "audit"))', [4]),
    ("[(if_statement) @x (class_definition) @x]", [7, 9]),
    ("(block (_) @one . (return_statement) @two)", [4, 11]),
    ("(function_definition name: (identifier) @fn_name !return_type parameters: (parameters (typed_parameter) @t))", [2]),
    ("(function_definition name: (identifier) @fn_name body: (block (return_statement)? @r))", [2, 8, 11]),
    ("(function_definition name: (identifier) @fn_name body: (block (return_statement)+ @r))", [2, 8]),
    ('((function_definition name: (identifier) @fn_name body: (block (expression_statement (call function: (identifier) @c)))) (#eq? @fn_name @c))', []),
    ("(assignment left: (identifier) @x)", [4]),
])
def test_anchors_predicates_choices_and_quantifiers(spark, query, lines):
    assert [x[2] for x in found(spark, {"a.py": CODE}, {"query": query})] == lines


@pytest.mark.parametrize("query", ["(this_is_not_valid @cap)", "(no_such_kind) @x", "(module", "(module)", "(module nofield: (_) @x)", '(module) @m (#foo? @m "x")', '(module) @m (#eq? @other "x")', "", "function_definition", "(module) @m )"])
def test_queries_that_cannot_be_read_are_warned_of(spark, query):
    given = pack({"query": query or " "})
    with pytest.warns(UserWarning, match="invalid query"):
        assert syntax.scan_trees(spark.createDataFrame([("a.py", CODE)], "file_path string, content string"), [given]) is None


def test_scripts_directives_and_test_files(spark):
    js = "// é\nconst s = `${ f('}') }`\nfunction pay(a) { // scan:disable=r1\n  return { a } }\nasync function refund() { audit(); }\nexport function repay() {}\nclass A { get(x) { return 1 } }\n"
    files = {"web/a.js": js, "tests/test_a.js": js}
    got = found(spark, files, {"query": "(function_declaration name: (identifier) @fn_name body: (statement_block) @fn_body)", "languages": ["javascript"], "must_not_contain": "audit"}, {"query": "(function_declaration) @f", "languages": ["javascript"], "skip_tests": True}, {"query": "(method_definition name: (property_identifier) @fn_name)", "languages": ["*"]})
    assert [x[:5] for x in got if x[1] == "web/a.js"] == [("r0", "web/a.js", 3, 10, 13), ("r0", "web/a.js", 6, 17, 22), ("r1", "web/a.js", 5, 1, 37), ("r1", "web/a.js", 6, 8, 27), ("r2", "web/a.js", 7, 11, 14)]
    assert {x[0] for x in got if x[1] != "web/a.js"} == {"r0", "r2"}
    out = syntax.scan_trees(spark.createDataFrame(list(files.items()), "file_path string, content string"), [pack({"query": "(function_declaration) @f", "languages": ["javascript"]})])
    assert {(r["file_path"], r["severity"], r["confidence"], r["in_test_file"]) for r in out.collect()} == {("web/a.js", "HIGH", 0.9, False), ("tests/test_a.js", "MEDIUM", 0.3, True)}


def test_nodes_are_intervals(spark):
    rows = syntax.nodes(spark.createDataFrame([("a.py", CODE), ("b.js", "f(g(1))"), ("c.py", "x = ("), ("d.py", ""), ("e.py", None)], "file_path string, content string")).collect()
    by = {(r["file_path"], r["id"]): r for r in rows}
    for r in rows:
        up = by.get((r["file_path"], r["parent"]))
        assert r["id"] <= r["last"] and (up is None or (up["id"] < r["id"] and r["last"] <= up["last"] and up["start"] <= r["start"] <= r["end"] <= up["end"] and r["place"] < r["n_siblings"]))
    assert {r["file_path"]: r["kind"] for r in rows if r["parent"] < 0} == {"a.py": "module", "b.js": "program", "c.py": "ERROR", "d.py": "module"}


# --- flows -----------------------------------------------------------------------------------------------------------------------

RULE = {"type": "pattern", "mode": "taint", "sources": [r"^request\.(?:args|GET)"], "sinks": [r"^redirect$", r"\.execute$"], "sanitizers": [r"^clean$"]}
FLOWS = {
    "direct": ("redirect(request.args['u'])", [1]),
    "variable": ("url = request.args.get('u')\nredirect(url)", [2]),
    "chain": ("a = request.GET\nb = a['x'] + '!'\nc = f'{b}'\nd = [x for x in c]\nredirect(to=d)", [5]),
    "cleaned": ("a = request.args.get('u')\na = clean(a)\nredirect(a)", []),
    "cleaned on one way": ("a = request.args.get('u')\nif ok:\n    a = clean(a)\nredirect(a)", [4]),
    "cleaned on both ways": ("a = request.args.get('u')\nif ok:\n    a = clean(a)\nelse:\n    a = '/'\nredirect(a)", []),
    "replaced": ("a = request.args.get('u')\na = '/'\nredirect(a)", []),
    "before": ("redirect(a)\na = request.args.get('u')", []),
    "loop": ("a = b = '/'\nfor i in range(3):\n    redirect(a)\n    a = b\n    b = request.args", [3]),
    "other function": ("def f():\n    a = request.args\ndef g():\n    redirect(a)", []),
    "closure": ("a = request.args\ndef g():\n    redirect(a)", [3]),
    "parameter hides": ("a = request.args\ndef g(a):\n    redirect(a)", []),
    "attribute": ("self.x = request.args\nredirect(self.y)", [2]),
    "method": ("db.cursor().execute('select ' + request.args['q'])", [1]),
    "compared": ("a = request.args['q'] == 'x'\nredirect(a)", []),
    "call": ("a = wrap(request.args)\nredirect(a.strip())", [2]),
    "walrus": ("if (a := request.args):\n    redirect(a)", [2]),
    "with and try": ("with open(request.args['p']) as f:\n    try:\n        x = f.read()\n    except OSError:\n        x = ''\nredirect(x)", [6]),
    "match": ("match request.args:\n    case {'u': u}:\n        redirect(u)", [3]),
    "augmented": ("a = '/'\na += request.args['u']\nredirect(a)", [3]),
    "suppressed": ("redirect(request.args)  # noqa", []),
    "deleted": ("a = request.args\ndel a\nredirect(a)", []),
    "broken": ("redirect(request.args", []),
}


def test_flows_from_sources_to_sinks(spark):
    files = spark.createDataFrame([(f"{name}.py", code) for name, (code, _) in FLOWS.items()], "file_path string, content string")
    got = {}
    for r in taint.scan_flows(files, [pack(RULE)]).collect():
        got.setdefault(r["file_path"][:-3], []).append(r["line_start"])
    assert {k: sorted(v) for k, v in got.items()} == {k: lines for k, (_, lines) in FLOWS.items() if lines}


def test_a_long_chain_and_rules_of_their_own(spark):
    chain = "v0 = request.args\n" + "".join(f"v{i + 1} = v{i}\n" for i in range(12)) + "redirect(v12)\nrun(v0)\n"
    other = RULE | {"sinks": ["^run$"], "severity": "CRITICAL"}
    files = spark.createDataFrame([("tests/a.py", chain), ("b.js", chain)], "file_path string, content string")
    got = sorted((r["rule_id"], r["line_start"], r["severity"], r["col_start"], r["col_end"]) for r in taint.scan_flows(files, [pack(RULE, other)]).collect())
    assert got == [("t/p/r0", 14, "MEDIUM", 1, 14), ("t/p/r1", 15, "MEDIUM", 1, 8)]
    assert taint.scan_flows(files, [pack({"query": QUERY})]) is None
    with pytest.raises(rules.RuleLoadError, match="mode"):
        pack(RULE | {"mode": "guess"})


# --- versions ---------------------------------------------------------------------------------------------------------------------

ORDER = ["0", "0.9", "1.0.dev1", "1.0.dev12", "1.0a1.dev1", "1.0a1", "1.0-alpha.2", "1.0b1", "1.0-rc.1", "1.0rc2", "1", "1.0.post1", "1.0.1", "1.0.10", "1.2", "1.10", "2.0.0-rc.1", "2", "10", "20230101", "1!0"]


def test_version_keys_sort_as_versions(spark):
    r = random.Random(1)
    shuffled = r.sample(ORDER, len(ORDER))
    df = spark.createDataFrame([(v,) for v in shuffled], "v string")
    assert [x["v"] for x in df.orderBy(dependencies.version_key(F.col("v"))).collect()] == ORDER
    same = spark.createDataFrame([("1.0", "v1"), ("1.0.0", "= 1"), ("1.0+build", "1"), ("1.0RC1", "1.0-c1"), ("1.0-1", "1.0.post1"), ("x", None), ("", "latest")], "a string, b string")
    assert all(x[0] for x in same.select(dependencies.version_key(F.col("a")).eqNullSafe(dependencies.version_key(F.col("b")))).collect())


def test_dependency_rules(spark):
    given = {"type": "dependency", "checks": [{"package": "Old_Lib", "language": "python", "max_version": "1.5", "reason": "old"}, {"package": "gone", "language": "javascript", "reason": "gone"}], "message": "{match} {reason}"}
    files = {
        "requirements.txt": "old-lib==1.4rc1\nold.lib\nOLD_LIB>=1.6  # newer\ngone==1\nold-lib<=1.5 # scan:disable\n", "web/package.json": '{"name": "gone", "scripts": {"x": "gone"},\n "devDependencies":\n  {"gone" : "^1.0.0"}}',
        "bad/package.json": "{", "tests/requirements-dev.txt": "old_lib ~= 1.0", "pyproject.toml": '[tool]\n"old-lib>=1.0"\nold_lib = "^1.2"\n', "a.py": "old-lib==1",
    }
    df = spark.createDataFrame(list(files.items()), "file_path string, content string")
    got = sorted((r["file_path"], r["line_start"], r["message"], r["severity"], r["col_start"]) for r in dependencies.scan_dependencies(df, [pack(given)]).collect())
    assert got == [
        ("pyproject.toml", 2, "old-lib 1.0 old", "HIGH", 2), ("pyproject.toml", 3, "old_lib 1.2 old", "HIGH", 1), ("requirements.txt", 1, "old-lib 1.4rc1 old", "HIGH", 1), ("tests/requirements-dev.txt", 1, "old_lib 1.0 old", "MEDIUM", 1),
        ("web/package.json", 3, "gone 1.0.0 gone", "HIGH", 5),
    ]


# --- lexical states ---------------------------------------------------------------------------------------------------------------

BODIES = {
    "a.js": ("U.init({\n  a: DataTypes.STRING, // a } here\n  b: DataTypes.TEXT, c: `}${ {x: `}`} }`,\n  d: DataTypes.UUID, e: /[}]/g,\n  f: DataTypes.DATE\n}, {})\ng: DataTypes.STRING", ["a", "b", "d", "f"]),
    "b.ts": ("@Entity()\nexport class U {\n  @Column() a: string = '}';\n  /* } */\n  @Column() b: number;\n}\n@Column() c: x", ["a", "b"]),
    "c.java": ('@Entity\nclass U {\n  private String a = "}";\n  char x = \'}\';\n  String y = """\n } " } """;\n  private int b;\n}\nprivate int c;', ["a", "b"]),
    "d.go": ("type U struct {\n  A string `json:\"}\"`\n  // }\n  B int\n}\nC int", ["A", "B"]),
    "e.php": ("class U extends Model {\n  $x = <<<EOT\n } '\nEOT;\n  # }\n  $casts = ['a' => 'int', 'b' => 'date'];\n}\n$z = ['c' => 'int'];", ["a", "b"]),
    "f.cs": ('class U {\n  public string A { get; set; } = @"}"" }";\n  public int B { get; }\n}\npublic int C { get; }', ["A", "B"]),
    "g.rs": ("#[derive(Queryable)]\nstruct U<'a> {\n  a: i32, /* } /* } */ } */\n  b: String, // r#\"}\"#\n}\nc: i32", ["a", "b"]),
    "h.rb": ('create_table "users" do |t|\n  t.string "a" # end\n  t.text "b"\n  x = <<~SQL\n  end\n  SQL\n  t.date "d"\nend\nt.date "c"', ["a", "b", "d"]),
    "i.prisma": ('model U {\n  a String @default("}")\n  b Int // }\n}\n', ["a", "b"]),
}


def test_bodies_end_where_the_code_does(spark):
    rows = structure.extract(spark.createDataFrame([(k, v[0]) for k, v in BODIES.items()], "file_path string, content string")).filter("kind = 'field'").collect()
    got = {}
    for r in rows:
        got.setdefault(r["file"], []).append(r["name"])
    assert got == {k: v[1] for k, v in BODIES.items()}


def test_masks_keep_length_and_line_ends():
    r = random.Random(3)
    for suffix in lexis.LEXES:
        for _ in range(300):
            text = "".join(r.choice(["'", '"', "`", "${", "{", "}", "/*", "*/", "//", "#", "\n", "\\", "a", " ", "r#\"", "<<<EOT\n", "<<~A\n", "\nEOT", "\nA", "=", "("]) for _ in range(r.randint(0, 40)))
            masked = lexis.mask(text, suffix)
            assert len(masked) == len(text) and [i for i, c in enumerate(masked) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
            assert all(a == b or a == " " for a, b in zip(masked, text, strict=True))


def test_rules_read_texts_once(spark, monkeypatch):
    """Only the nodes that patterns speak of are stored, with what rules read of them; no rule shuffles or splits the files' texts again."""
    kept = []
    monkeypatch.setattr(syntax, "stored", lambda df: kept.append(df) or df)
    files = spark.createDataFrame([("a.py", CODE), ("b.py", "#" * 300 + "\n  \ndef pay(): pass  # " + "x" * 300 + "\n")], "file_path string, content string")
    out = syntax.scan_trees(files, [pack({"query": QUERY, "must_not_contain": "audit_log"}, {"query": "(class_definition !name) @c"}, {"query": "(call function: (identifier) @fn_name)"})])
    assert sorted((r["rule_id"], r["line_start"], len(r["snippet"])) for r in out.collect()) == [("t/p/r0", 2, 31), ("t/p/r0", 3, 200), ("t/p/r0", 11, 17), ("t/p/r2", 4, 32), ("t/p/r2", 10, 15)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(content" not in plan and "encode(content" not in plan
    rows = kept[0].collect()
    assert {r["kind"] for r in rows} == {"function_definition", "identifier", "block", "call", "class_definition"} and all(r["field"] in ("name", "function") for r in rows if r["kind"] == "identifier")
    assert {r["text"] for r in rows if r["kind"] == "identifier"} == {"transfer", "credit", "inner", "pay", "f", "audit_log", "Desk"}
