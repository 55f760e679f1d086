import json
import re
import warnings

import pytest
from pyspark.sql import functions as F

from spanwarden.operators import reports, rules, scan
from spanwarden.plans import commands
from spanwarden.sources import files as src

PACKS = rules.load_pack_directory(commands.PACKS)
DIRTY = {
    "src/a.py": 'import pickle\nx = eval(y)\npassword = "hunter22"\nrequests.get(u, verify=False)\ntry:\n  a()\nexcept:\n  pass\nhashlib.md5(x)\napp.run(debug=True)',
    "src/b.js": "const f = new Function('x')\nfetch('http://shop.example/x')\nhttps.get({rejectUnauthorized: false})",
    "tests/t.py": "pickle.loads(b)",
}
CLEAN = {"src/c.py": "x = literal_eval(y)\npassword = os.environ['P']\neval(z)  # noqa\neval(z)  # scan:disable=dynamic-code\neval(z)  # noqa: generic/web/dynamic-code", "src/d.js": "fetch('http://localhost/x')"}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "file_path string, content string")


def plain(files, packs):
    """The same rules by nested loops over lines."""
    from spanwarden.functions import paths

    out = set()
    for pack in packs:
        for path, content in files.items():
            lang = next((v for k, v in paths.LANGUAGES.items() if path.endswith(k)), None)
            test = any(re.search(p, path, re.I) for p in paths.TEST_PATHS)
            for r in pack.rules:
                if r.type != "pattern" or not ("*" in r.languages or lang in r.languages) or (r.skip_tests and test):
                    continue
                for n, line in enumerate(content.splitlines(), 1):
                    m = next((m for p in r.patterns if (m := re.search(p, line, re.I))), None)
                    if not m or any(re.search(p, line, re.I) for p in r.exclude_patterns):
                        continue
                    hidden = False
                    for head, ids in ((r"(?:#|//)\s*noqa(?::\s*([\w/,.\-\s]+))?", [pack.full_id(r)]), (r"(?:#|//)\s*scan:disable(?:=\s*([\w/,.\-\s]+))?", [pack.full_id(r), r.id])):
                        if s := re.search(head, line, re.I):
                            hidden |= s[1] is None or any(i in [x.strip() for x in s[1].split(",")] for i in ids)
                    if not hidden:
                        out.add((pack.full_id(r), path, n, m.start() + 1, m.end() + 1, "MEDIUM" if test and r.severity in ("CRITICAL", "HIGH") else r.severity))
    return out


def test_scan_is_the_nested_loop(spark):
    files = DIRTY | CLEAN
    got = {(r["rule_id"], r["file_path"], r["line_start"], r["col_start"], r["col_end"], r["severity"]) for r in scan.scan(frame(spark, files), PACKS).collect()}
    assert got == plain(files, PACKS)
    assert {p for _, p, *_ in got} == set(DIRTY)


def test_redaction_and_messages(spark):
    v = scan.scan(frame(spark, DIRTY), PACKS).filter("rule_id = 'generic/web/hard-coded-password'").first()
    assert "hunter22" not in v["snippet"] and "[REDACTED]" in v["snippet"]


def test_malformed_patterns_are_left_out(spark):
    rule = rules.Rule("x", "x", "pattern", "LOW", "m", languages=("*",), patterns=("(", "eval"))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = scan.scan(frame(spark, {"a.py": "eval"}), [rules.Pack("p", "1", "p", (rule,))]).count()
    assert got == 1 and any("malformed" in str(w.message) for w in said)


@pytest.mark.parametrize("body,part", [("[", "valid YAML"), ("[1]", "mapping"), ("rules: []", "manifest"), ("manifest: {id: a, version: 1}", "name"), ("manifest: {id: a, version: 1, name: n}\nrules: [{id: r, type: odd}]", "unknown rule type"), ("manifest: {id: a, version: 1, name: n}\nrules: [{id: r, type: pattern, name: n, severity: LOW, message: m, languages: ['*']}]", "patterns")])
def test_pack_errors_speak(tmp_path, body, part):
    (tmp_path / "p.yml").write_text(body)
    with pytest.raises(rules.RuleLoadError, match=part):
        rules.load_pack(tmp_path / "p.yml")


def test_baseline_gate_and_renderings(spark, tmp_path):
    v = scan.scan(frame(spark, DIRTY), PACKS).persist()
    assert scan.without_known(v, scan.baseline_of(v)).count() == 0
    (tmp_path / "b.json").write_text("".join(reports.baseline_document(v, "now")))
    assert scan.without_known(v, src.read_baseline(spark, str(tmp_path / "b.json"))).count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert src.read_baseline(spark, str(tmp_path / "bad.json")).count() == 0
    assert src.read_baseline(spark, str(tmp_path / "none.json")).count() == 0
    assert scan.gate(v).first()["status"] == "failed"
    assert scan.gate(v.filter("false")).first()["status"] == "passed"
    doc = json.loads("".join(reports.sarif_document(v, "t", "1", "r")))
    run = doc["runs"][0]
    assert len(run["results"]) == v.count() and all(run["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in run["results"])
    many = v.crossJoin(spark.range(20)).withColumn("seq", F.struct("seq.*", "id")) if v.count() >= 6 else v
    sizes = {r["batch"]: len(r["annotations"]) for r in reports.annotation_batches(many).collect()}
    assert all(n == 50 for b, n in sizes.items() if b < max(sizes)) and sum(sizes.values()) == many.count()
    assert reports.review_payload(v.filter("false"), "c") is None
    assert reports.review_payload(v, "c")["event"] == "REQUEST_CHANGES"
    assert "production" in reports.comment(v, "failed")
    counts = {"overall_status": "failed", "total_files_scanned": 2, "total_violations": v.count(), "by_severity": {"HIGH": 1, "LOW": 0}, "by_pack": {"p": 1}}
    done = reports.check_run(v, counts, "now")
    assert done["conclusion"] == "failure" and 0 < len(done["output"]["annotations"]) <= 50 and all("raw_details" not in a or a["raw_details"].startswith("Fix: ") for a in done["output"]["annotations"])
    assert ": 1 high." in done["output"]["summary"] and "low" not in done["output"]["summary"] and "`p` has 1" in done["output"]["summary"]
    assert len(reports.summary_text(counts | {"by_pack": {"p" * 70_000: 1}})) < 65_100
    body = reports.review_payload(v, "c")["comments"][0]["body"]
    assert "% sure)" in body and "Turn off with `" in body


def test_commands(spark, tmp_path, capsys):
    for kind, files in (("dirty", DIRTY), ("clean", CLEAN)):
        for p, c in files.items():
            (tmp_path / kind / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / kind / p).write_text(c)
    (tmp_path / "dirty" / ".hidden").mkdir()
    (tmp_path / "dirty" / ".hidden" / "x.py").write_text("eval(x)")
    assert commands.main(["scan", str(tmp_path / "dirty")], spark) == 1
    assert ".hidden" not in capsys.readouterr().out
    assert commands.main(["scan", str(tmp_path / "clean")], spark) == 0
    base = str(tmp_path / "base.json")
    assert commands.main(["baseline", str(tmp_path / "dirty"), "--output", base], spark) == 0
    assert commands.main(["ci", str(tmp_path / "dirty"), "--baseline", base, "--format", "sarif", "--output", str(tmp_path / "o.sarif")], spark) == 0
    assert commands.main(["validate-pack", str(commands.PACKS / "web.yml")]) == 0
    assert commands.main(["validate-pack", str(tmp_path / "none.yml")]) == 2
    assert commands.main(["init", str(tmp_path / "c.yml")]) == 0 and commands.main(["init", str(tmp_path / "c.yml")]) == 1
    assert commands.main(["compliance", str(tmp_path / "dirty")], spark) == 0
