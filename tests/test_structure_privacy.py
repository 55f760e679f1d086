import json

from pyspark.sql import functions as F

from spanwarden.operators import judged, privacy, structure
from spanwarden.streaming import events

PY = '''
from django.db import models
import cryptography.fernet
class Patient(models.Model):
    name = models.CharField(max_length=50, null=True)
    doctor = models.ForeignKey("Doctor", on_delete=models.PROTECT)
    aadhaar = EncryptedCharField(max_length=12)
    date_of_birth = models.DateField()
class PatientViewSet(viewsets.ModelViewSet):
    permission_classes = [IsAuthenticated]
router.register(r"patients", PatientViewSet)
@app.get("/x/{id}")
async def get_x(id: int, user=Depends(get_user)):
    pass
def transfer_money(a):
    return a
def refund(a):
    audit(a)
'''
FILES = {
    "app/m.py": PY, "broken.py": "def (", "r.js": "const b=require('bcrypt')\napp.get('/users', auth, listUsers)\nUser.init({ email: DataTypes.STRING }, { sequelize })\n",
    "U.java": '@Entity\npublic class Acc {\n private String name;\n}\n@RequestMapping("/api/")\nclass C { @GetMapping("/a") public X get() {} }', "u.rb": "class Shop < ApplicationRecord\n  has_many :orders, dependent: :destroy\nend\n", "s.prisma": "model Post {\n  id Int\n  title String?\n}\n",
    "m.go": 'type Car struct {\n\tID uint `gorm:"primaryKey"`\n}\nfunc r() { e.GET("/cars", h.List) }', "w.php": "<?php class Bill extends Model { protected $casts = ['paid' => 'boolean']; }\nRoute::post('/bills', [BillController::class, 'store']);", "e.cs": '[Route("api/e")]\nclass Emp {\n public string Name { get; set; }\n}\n[HttpGet("x")] public X Get() {}', "d.rs": "#[derive(Queryable)]\npub struct Dog {\n pub age: i32,\n}",
}


def tables(spark):
    return structure.code_tables(spark.createDataFrame(list(FILES.items()), "file_path string, content string"))


def test_tables(spark):
    c = tables(spark)
    assert {r["name"] for r in c["models"].collect()} >= {"Patient", "User", "Acc", "Shop", "Post", "Car", "Bill", "Emp", "Dog"}
    fields = {(r["model"], r["name"]): r for r in c["fields"].collect()}
    assert fields["Patient", "aadhaar"]["is_encrypted"] and fields["Patient", "name"]["is_nullable"] and fields["Patient", "name"]["max_length"] == 50
    assert fields["Post", "title"]["field_type"] == "String?"
    edges = {(r["source_model"], r["target_model"], r["on_delete"], r["is_blocker"]) for r in c["delete_paths"].collect()}
    assert edges == {("Patient", "Doctor", "PROTECT", True), ("Shop", "Order", "CASCADE", False)}
    routes = {(r["path"], tuple(r["http_methods"]), r["requires_auth"]) for r in c["endpoints"].collect()}
    assert routes >= {("/users", ("GET",), False), ("/api//a", ("GET",), False), ("/x/{id}", ("GET",), True), ("/patients/", ("GET", "POST", "PUT", "PATCH", "DELETE"), True), ("/cars", ("GET",), False), ("/bills", ("POST",), False), ("/api/e/x", ("GET",), False)}
    assert {(r["module"], r["category"]) for r in c["libraries"].collect()} >= {("bcrypt", "hashing"), ("cryptography.fernet", "encryption")}


def test_functions_without_audit(spark):
    got = structure.unaudited_functions(spark.createDataFrame(list(FILES.items()), "file_path string, content string"), "p/x", "transfer|refund", "audit").collect()
    assert [(r["name"], r["line_start"], r["col_start"], r["confidence"]) for r in got] == [("transfer_money", 15, 5, 0.9)]


def test_sections(spark):
    c = tables(spark)
    schema = "model string, field string, classification string, reason string"
    pii = spark.createDataFrame([("Patient", "name", "PII", ""), ("Patient", "aadhaar", "SENSITIVE_PII", "")], schema)
    got = {r["section"]: r for r in privacy.report(c, pii).collect()}
    assert got["§8(4)"]["status"] == "PARTIAL" and got["§8(4)"]["blockers"] == ["not encrypted: Patient.name"]
    assert got["§9"]["status"] == "NON_COMPLIANT" and got["§8(5)"]["status"] == "NON_COMPLIANT" and got["§4"]["status"] == "UNKNOWN" and got["§4"]["llm_calls_made"] == 1
    nothing = privacy.report(c, spark.createDataFrame([], schema)).collect()
    assert {r["status"] for r in nothing} == {"COMPLIANT"} and [r["section"] for r in nothing] == sorted(r["section"] for r in nothing)
    verdict = spark.createDataFrame([("§7(3)", "PARTIAL")], "section string, verdict string")
    assert privacy.erasure(c, pii, verdict).first()["status"] == "PARTIAL"

    def broken(code, pii):
        raise RuntimeError("no")

    assert privacy.report(c, pii, (broken,)).first()["status"] == "UNKNOWN"


def test_recorded_answers(spark):
    said = spark.createDataFrame([("a.py", json.dumps({"violations": [{"rule_id": "p/r", "line_start": 2, "line_end": 9, "message": "m", "confidence": 0.8, "snippet": "s"}]})), ("b.py", "no json"), ("c.py", None)], "file_path string, answer string")
    rows = judged.parse(said, "answer", judged.ANSWER).collect()
    assert [(r["file_path"], r["rule_id"], r["line_end"]) for r in rows] == [("a.py", "p/r", 9)]
    numbered = spark.createDataFrame([("a.py", "1"), ("b.py", "2")], "file_path string, numbered string")
    assert {r["file_path"]: r["answer"] for r in judged.judge(numbered, lambda p, b: p + b).collect()} == {"a.py": "a.py1", "b.py": "b.py2"}


def test_guard():
    now = [0.0]
    g = judged.Guard(failures=2, rest=60, calls=2, period=60, max_wait=30, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))

    def bad():
        raise OSError

    for _ in range(2):
        try:
            g(bad)
        except OSError:
            pass
    assert g.state == "open" and g(lambda: 1) is None
    now[0] = 61.0
    assert g(lambda: 1) == 1 and g.state == "closed"


def test_event_stream(spark, tmp_path):
    def event(action="opened", state="open", draft=False, number=1, sha="s"):
        return json.dumps({"action": action, "pull_request": {"number": number, "state": state, "draft": draft, "head": {"sha": sha}}, "repository": {"full_name": "o/r"}, "installation": {"id": 5}})

    lines = [event(), event(), event(draft=True), event(state="closed"), event(action="labeled"), event(number=2), "no json"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    raw = spark.readStream.text(str(tmp_path / "in")).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    seen = []
    q = events.run(events.to_scan(raw), lambda df, n: seen.extend((r["repo"], r["number"], r["sha"]) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == [("o/r", 1, "s"), ("o/r", 2, "s")]


def test_signatures(spark):
    import hashlib
    import hmac

    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("body", good), ("body", "sha256=0"), ("body", None)], "b string, s string")
    assert [r[0] for r in df.select(events.signature_status(F.col("b"), F.col("s"), "k")).collect()] == [200, 401, 401]
    assert df.select(events.signature_status(F.col("b"), F.col("s"), None)).first()[0] == 500


def test_routes_of_each_framework(spark):
    files = {
        "config/routes.rb": "resources :users\nget '/a/', to: 'x#y'\n", "routes/api.php": "Route::apiResource('bills', X::class);", "a.ts": "@Controller('/api/')\nclass A {\n @Get()\n x() {}\n @Get('y/')\n z() {}\n}\n",
        "v.py": "class Book(models.Model):\n    t = models.CharField()\nclass Pen(models.Model):\n    t = models.CharField()\nclass S(APIView):\n    queryset = Book.objects.all()\n    def delete(self): pass\nurlpatterns = [path('b/', S.as_view())]\n@app.get('/p')\ndef p(x: Pen): pass\n",
    }
    rows = structure.extract(spark.createDataFrame(list(files.items()), "file_path string, content string"))
    got = {(r["path"], ",".join(r["http_methods"]), ",".join(r["models_read"]), ",".join(r["models_deleted"])) for r in structure.endpoints(rows, structure.models(rows)).collect()}
    resource = {("/users", v, "", "") for v in ("GET", "POST", "PUT", "PATCH", "DELETE")} | {("/bills", v, "", "") for v in ("GET", "POST", "PUT", "PATCH", "DELETE")}
    assert got == resource | {("/a/", "GET", "", ""), ("/api", "GET", "", ""), ("/api/y", "GET", "", ""), ("b/", "DELETE", "", "Book"), ("/p", "GET", "Pen", "")}


def test_classification_is_kept_by_commit(spark, tmp_path):
    pii = spark.createDataFrame([("A", "b", "PII", "r")], "model string, field string, classification string, reason string")
    path = f"{tmp_path}/kept"
    assert privacy.load_classification(spark, path, "/r", "abc") is None
    privacy.save_classification(pii, path, "/r", "abc")
    privacy.save_classification(pii, path, "/r", None)
    assert privacy.load_classification(spark, path, "/r", "abc").collect() == pii.collect()
    assert privacy.load_classification(spark, path, "/r", "other") is None and privacy.load_classification(spark, path, "/r", None) is None


def test_fields_are_shown_and_batched(spark):
    c = tables(spark)
    batches = privacy.model_batches(c["models"], c["fields"], 3)
    said = {r["model"]: r["said"] for r in batches.collect()}
    assert "- name: CharField max_length=50 nullable" in said["Patient"] and "- doctor: ForeignKey -> Doctor (on_delete=PROTECT)" in said["Patient"] and "[ENCRYPTED]" in said["Patient"]
    assert sorted(r["batch"] for r in privacy.prompts(batches).collect()) == list(range(1, (len(said) + 2) // 3 + 1))


def test_report_text(spark):
    rows = spark.createDataFrame([("§9", "Children", "PARTIAL", ["e"], [], ["do"], 1)], "section string, title string, status string, evidence array<string>, blockers array<string>, remediation array<string>, llm_calls_made int")
    said = privacy.report_text(rows, "/repo", "0123456789abcdef")
    assert "[WARN] §9 Children" in said and "  Commit:     0123456789ab\n" in said and "    - e" in said and "Blockers" not in said and said.endswith("=" * 72)


def test_deliveries_from_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, sha in enumerate("aab"):
        body = {"action": "opened", "pull_request": {"number": 1, "state": "open", "draft": False, "head": {"sha": sha}}, "repository": {"full_name": "o/r"}, "installation": {"id": 1}}
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(body, indent=1))
    seen = []
    q = events.run(events.to_scan(events.deliveries(spark, str(tmp_path / "in"))), lambda df, n: seen.extend(r["sha"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == ["a", "b"]
