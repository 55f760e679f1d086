"""The documents as one code base of many languages and frameworks, with their texts in it.

Each file is a template whose marks ``<d>``, ``<d+14>`` stand for numbers and ``«condition|text|other text»`` for choices. A template becomes an expression of plain
SQL, so Spark and any other engine make the same files from the same documents. The text follows the code as comment.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: By the document's number modulo the length: path, mark of comments, content. ``t`` is the number divided by that length.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("app/people<d>.py", "# ", """from django.db import models


class Person<d>(models.Model):
    name = models.«t % 5 = 2|EncryptedCharField|CharField»(max_length=80)
«t % 3 = 0|    date_of_birth = models.DateField(null=True)
|»«t % 4 = 1|    delete_after = models.DateTimeField()
|»«t % 5 = 0|    is_deleted = models.BooleanField()
|»    owner = models.ForeignKey('Person<d+14>', on_delete=models.«t % 2 = 0|CASCADE|PROTECT»)
«t % 6 = 1|
    def delete(self):
        return None
|»"""),
    ("app/views<d>.py", "# ", """from rest_framework import viewsets


class Person<d-1>«t % 2 = 0|ViewSet(viewsets.ModelViewSet)|View(APIView)»:
    permission_classes = [«t % 3 = 0|IsAuthenticated|AllowAny»]

    def «t % 2 = 0|perform_create|post»(self, request):
        return «t % 4 = 3|None|Person<d-1>.objects.all()»


«t % 2 = 0|router.register('people<d>', Person<d-1>ViewSet)|urlpatterns = [path('people<d>/', Person<d-1>View.as_view())]»
# «t % 3 = 1|has_consented is asked for|nothing is asked»
"""),
    ("api/routes<d>.py", "# ", """from fastapi import APIRouter, Depends
router = APIRouter()


@router.«t % 3 = 1|delete|post»('/fast<d>')
async def act<d>(person: Person<d-2>, user=Depends(get_«t % 4 = 0|user|db»)):
    return person
"""),
    ("web/user<d>.ts", "// ", """@Entity()
export class User<d> {
  @Column() email: string;
  /* } */
  @Column() «t % 2 = 0|phone|fax»: number;
}
@Controller('users<d>')
export class Users<d>Controller {
  @«t % 2 = 0|Delete|Get»(':id')
  act<d>() {}
}
"""),
    ("cmd/m<d>.go", "// ", """type Account<d> struct {
	Name string `json:"}"`
	// }
	Size int `gorm:"column:size"`
}
func main() { r.«t % 2 = 0|DELETE|GET»("/accounts<d>", drop<d>) }
"""),
    ("app/Member<d>.php", "// ", """<?php
class Member<d> extends Model {
  # }
  protected $casts = ['born' => 'date', 'note' => 'string'];
}
Route::«t % 2 = 0|delete|get»('/members<d>', 'act<d>');
"""),
    ("Api/Client<d>.cs", "// ", """[Route("clients<d>")]
public class Client<d>Controller {
  [Http«t % 2 = 0|Delete|Get»("{id}")]
  public IActionResult Act<d>(int id) { return Ok("}"); }
}
public class Client<d> {
  public string Name { get; set; }
  public int Size { get; set; }
}
"""),
    ("src/row<d>.rs", "// ", """#[derive(Queryable)]
pub struct Row<d> {
  pub name: String, // }
  size: Option<i32>,
}
"""),
    ("db/doc<d>.js", "// ", """const s = `${ '}' }`
mongoose.model('Doc<d>', s)
app.«t % 2 = 0|delete|get»('/docs<d>', act<d>)
"""),
    ("src/Api<d>.java", "// ", """@RequestMapping("/api<d>")
public class Api<d> {
  @«t % 2 = 0|Delete|Get»Mapping("/x")
  public void act<d>() {}
}
"""),
    ("config/r<d>/routes.rb", "# ", """resources :orders<d>
get '/ping<d>', to: 'ping#show'
"""),
    ("conf<d>/settings.py", "# ", """DEFAULT_PERMISSION_CLASSES = ['«t % 2 = 0|IsAuthenticated|AllowAny»']
«t % 3 = 0|MIDDLEWARE = ['x.ConsentMiddleware']
|»AUTH = '«t % 2 = 0|Session|JWT»Authentication'
"""),
    ("«t % 6 = 1|jobs/management/commands/job<d>.py|jobs/job<d>.py»", "# ", """«t % 6 = 0|retention_policy = 30|»«t % 6 = 1|class Command(BaseCommand): send_mail()|»«t % 6 = 2|ok = age >= 18|»«t % 6 = 3|parental_consent = True|»«t % 6 = 4|incident_response()|»«t % 6 = 5|import sentry_sdk|»
"""),
    ("app/extra<d>.py", "# ", """from django.db import models
class «t % 4 = 0|ConsentRecord|»«t % 4 = 1|ChildProfile|»«t % 4 = 2|AuditLog|»«t % 4 = 3|Ledger|»<d>(models.Model):
    given = models.BooleanField()
"""),
)
KINDS = len(TEMPLATES)
BREAKS = "[\r\n\x00\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]+"


def _quoted(text: str) -> str:
    pieces = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return " || chr(10) || ".join(pieces)


def sql(template: str) -> str:
    """A template as an expression of SQL over ``d`` and ``t``."""
    out = []
    for part in re.split(r"(«[^«»]*»|<d[+-]?\d*>)", template):
        if part.startswith("«"):
            test, yes, no = part[1:-1].split("|")
            out.append(f"CASE WHEN {test} THEN {sql(yes)} ELSE {sql(no)} END")
        elif re.fullmatch(r"<d[+-]?\d*>", part):
            out.append(f"CAST({part[1:-1]} AS STRING)")
        elif part:
            out.append(_quoted(part))
    return "(" + (" || ".join(out) or "''") + ")"


def choice(values: list[str]) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


PATH, MARK, CONTENT = (choice(v) for v in ([sql(p) for p, _, _ in TEMPLATES], [_quoted(m) for _, m, _ in TEMPLATES], [sql(c) for _, _, c in TEMPLATES]))


def documents_as_services(documents: DataFrame) -> DataFrame:
    """doc_id, file_path, content: every document as a source file of a code base that has models, routes, settings and jobs."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), BREAKS, "\n")
    rows = documents.select("doc_id", F.col("doc_id").alias("d"), F.pmod("doc_id", F.lit(KINDS)).cast("int").alias("k"), F.floor(F.col("doc_id") / KINDS).alias("t"), said.alias("said"))
    rows = rows.select("*", F.expr(PATH).alias("file_path"), F.expr(MARK).alias("mark"), F.expr(CONTENT).alias("code"))
    return rows.select("doc_id", "file_path", F.concat("code", "mark", F.replace("said", F.lit("\n"), F.concat(F.lit("\n"), "mark"))).alias("content"))
