"""Structural tables from source files: models, fields, endpoints, delete paths, library imports.

Each language is a few header regexes; one small helper turns a file into rows (kind, name, line, attributes), and all
relational work on them (classification, merge, dedupe, joins of routes and views) is DataFrames.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from . import fixed, lexis

#: Files whose contents a task holds as strings at once.
FILES_AT_ONCE = 64
ROW = "file string, kind string, owner string, name string, line int, value string, extra string"


@dataclass(frozen=True)
class Syntax:
    """How a model starts, where its body ends (``{`` its closing brace, else a pattern, None: it has none), what the body must hold,
    and how a field looks inside (groups: name, type, extra)."""

    head: str
    body: str | None
    field: str
    must: str = ""


_COLUMN = r"(?P<name>\w+)\s*:\s*\{?\s*(?:type\s*:\s*)?(?:DataTypes|Sequelize)\.(?P<type>\w+)"
MODEL_SYNTAX: dict[str, tuple[Syntax, ...]] = {
    ".prisma": (Syntax(r"^model\s+(?P<name>\w+)\s*\{", "{", r"^[ \t]*(?P<name>\w+)[ \t]+(?P<type>\w+(?:\[\])?\??)"),),
    ".js": (
        Syntax(r"class\s+(?P<name>\w+)\s+extends\s+(?:\w+\.)?Model\s*\{", "{", _COLUMN),
        Syntax(r"(?P<name>\w+)\.init\(\s*\{", "{", _COLUMN),
        Syntax(r"mongoose\.model\(\s*['\"](?P<name>\w+)['\"]", None, r"(?!)"),
    ),
    ".ts": (Syntax(r"@Entity\([^)]*\)\s*(?:export\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)", "{", r"@\w*Column\w*\([^)]*\)\s*(?:public\s+|private\s+)?(?P<name>\w+)[!?]?\s*:\s*(?P<type>\w+)"),),
    ".java": (
        Syntax(
            r"@Entity\b(?:(?!@Entity\b).)*?\bclass\s+(?P<name>\w+)", "{",
            r"(?:private|protected|public)\s+(?P<type>[A-Z]\w*|int|long|double|float|boolean)(?:<[^>]*>)?\s+(?P<name>\w+)\s*[;=]",
        ),
    ),
    ".rb": (
        Syntax(r"^\s*class\s+(?P<name>\w+)\s*<\s*[\w:]+", r"^end", r"\b(?P<type>belongs_to|has_many|has_one)\s+:(?P<name>\w+)(?P<extra>[^\n]*)"),
        Syntax(r"create_table\s+\"(?P<name>\w+)\"", r"^\s*end", r"t\.(?P<type>\w+)\s+\"(?P<name>\w+)\""),
    ),
    ".go": (Syntax(r"type\s+(?P<name>\w+)\s+struct\s*\{", "{", r"^[ \t]*(?P<name>[A-Z]\w*)[ \t]+(?P<type>[\w.*\[\]]+)", r"(?:gorm|json):"),),
    ".php": (
        Syntax(r"class\s+(?P<name>\w+)\s+extends\s+(?:Model|Authenticatable)\b", "{", r"['\"](?P<name>\w+)['\"]\s*=>\s*['\"](?P<type>\w+)"),
        Syntax(r"Schema::create\(\s*['\"](?P<name>\w+)['\"]", "{", r"\$table->(?P<type>\w+)\(\s*['\"](?P<name>\w+)"),
    ),
    ".cs": (Syntax(r"class\s+(?P<name>\w+)", "{", r"public\s+(?P<type>[\w<>?\[\]]+)\s+(?P<name>\w+)\s*\{\s*get;", r"\{\s*get;"),),
    ".rs": (Syntax(r"#\[derive\([^)]*(?:Queryable|FromRow|DeriveEntityModel)[^)]*\)\][^{;]*struct\s+(?P<name>\w+)", "{", r"(?:pub\s+)?(?P<name>\w+)\s*:\s*(?P<type>[\w<>:]+)"),),
}
MODEL_SYNTAX[".tsx"], MODEL_SYNTAX[".jsx"] = MODEL_SYNTAX[".ts"], MODEL_SYNTAX[".js"]
#: Per suffix: routes that stand for a whole resource (group: path), each with its verbs and actions.
RESOURCE_SYNTAX = {
    ".rb": (r"resources?\s+:(?P<path>\w+)", (("GET", "index"), ("GET", "show"), ("POST", "create"), ("PUT", "update"), ("PATCH", "update"), ("DELETE", "destroy"))),
    ".php": (r"Route::(?:api)?[Rr]esource\s*\(\s*['\"](?P<path>[^'\"]+)['\"]", tuple((v, "resource") for v in ("GET", "POST", "PUT", "PATCH", "DELETE"))),
}
#: Per suffix: routes (groups: verb, path, handler; a prefix is found once a file).
ROUTE_SYNTAX: dict[str, tuple[str | None, str]] = {
    ".js": (None, r"\b(?:app|router)\.(?P<verb>get|post|put|patch|delete|all)\(\s*['\"`](?P<path>[^'\"`]+)['\"`]\s*,\s*(?:[\w.]+\s*,\s*)*(?P<handler>[\w.]*)"),
    ".ts": (r"@Controller\(\s*['\"`]?(?P<path>[^'\"`)]*)", r"@(?P<verb>Get|Post|Put|Patch|Delete|All)\(\s*(?:['\"`](?P<path>[^'\"`]*)['\"`])?\s*\)[^\w]*(?:@[^\n]*\n\s*)*(?:public\s+)?(?:async\s+)?(?P<handler>\w+)"),
    ".java": (r"@RequestMapping\(\s*(?:value\s*=\s*)?\"(?P<path>[^\"]*)\"[^)]*\)[^{]*class", r"@(?P<verb>Get|Post|Put|Patch|Delete)Mapping(?:\(\s*(?:value\s*=\s*)?(?:\"(?P<path>[^\"]*)\")?[^)]*\))?[^{;]*?\b(?P<handler>\w+)\s*\("),
    ".rb": (None, r"^\s*(?P<verb>get|post|put|patch|delete)\s+['\"](?P<path>[^'\"]+)['\"](?:\s*(?:=>|,\s*to:)\s*['\"](?P<handler>[^'\"]+))?"),
    ".go": (None, r"\.(?P<verb>GET|POST|PUT|PATCH|DELETE|HandleFunc|Get|Post|Put|Patch|Delete)\(\s*\"(?P<path>[^\"]+)\"\s*,\s*(?P<handler>[\w.]+)"),
    ".php": (None, r"Route::(?P<verb>get|post|put|patch|delete|any)\(\s*['\"](?P<path>[^'\"]+)['\"]\s*,\s*(?P<handler>[^)\n]*)"),
    ".cs": (r"\[Route\(\s*\"(?P<path>[^\"]*)\"", r"\[Http(?P<verb>Get|Post|Put|Patch|Delete)(?:\(\s*\"(?P<path>[^\"]*)\"\s*\))?\][^{;]*?\b(?P<handler>\w+)\s*\("),
}

def _suffix(path: str) -> str:
    return "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def _body(code: str, head: re.Match, end: str | None) -> tuple[int, int]:
    """Where the body of a model starts and ends in masked code, however long it is."""
    if end is None:
        return head.end(), head.end()
    if end != "{":
        last = re.compile(end, re.M).search(code, head.end())
        return head.end(), last.start() if last else len(code)
    start = code.find("{", head.end() - 1)
    return (start + 1, lexis.closing(code, start)) if start >= 0 else (head.end(), head.end())


def _regex_rows(path: str, content: str) -> Iterator[tuple]:
    s = _suffix(path)
    breaks = [m.start() for m in re.finditer("\n", content)]
    line = lambda at: bisect_left(breaks, at) + 1
    code = lexis.mask(content, s) if s in MODEL_SYNTAX else content
    for syntax in MODEL_SYNTAX.get(s, ()):
        for m in re.finditer(syntax.head, content, re.S | re.M):
            start, end = _body(code, m, syntax.body)
            body = content[start:end]
            if syntax.must and not re.search(syntax.must, body):
                continue
            yield path, "model", None, m["name"], line(m.start()), None, None
            for f in re.finditer(syntax.field, body, re.M):
                more = f.groupdict()
                yield path, "field", m["name"], more["name"], line(start + f.start()), more.get("type"), more.get("extra")
    if s in ROUTE_SYNTAX:
        prefix, route = ROUTE_SYNTAX[s]
        base = re.search(prefix, content, re.S) if prefix else None
        for m in re.finditer(route, content, re.M):
            yield path, "route", base["path"] if base else None, m["path"] or "", line(m.start()), m["verb"].upper(), m["handler"]
    if s in RESOURCE_SYNTAX:
        pattern, actions = RESOURCE_SYNTAX[s]
        for m in re.finditer(pattern, content):
            for verb, action in actions:
                yield path, "route", None, f"/{m['path']}", line(m.start()), verb, f"{m['path']}#{action}"


def _python_rows(path: str, content: str) -> Iterator[tuple]:
    """Classes with bases and assigned fields, route decorators, URL lists, functions, imports: by the standard parser."""
    import ast

    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:  # too deeply nested source overflows the parser's stack
        yield path, "error", None, type(e).__name__, 0, None, None
        return
    said = lambda node: ast.unparse(node) if node is not None else ""
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            bases = ",".join(map(said, node.bases))
            yield path, "class", None, node.name, node.lineno, bases, ",".join(f.name for f in node.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef))
            if "View" in bases:  # what the view's code names: a model, or an attribute of what is named like one but for an s
                names = {x.id for x in ast.walk(node) if isinstance(x, ast.Name)}
                owners = {x.value.id + "s" for x in ast.walk(node) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name)}
                yield path, "names", None, node.name, node.lineno, ",".join(sorted(names)), ",".join(sorted(owners))
            for item in node.body:
                target = item.targets[0] if isinstance(item, ast.Assign) else item.target if isinstance(item, ast.AnnAssign) else None
                if isinstance(target, ast.Name) and isinstance(item.value, ast.Call):
                    yield path, "field", node.name, target.id, item.lineno, said(item.value.func).rsplit(".", 1)[-1], "|".join([*map(said, item.value.args), *(f"{k.arg}={said(k.value)}" for k in item.value.keywords)])
                elif isinstance(target, ast.Name) and item.value is not None:
                    yield path, "attribute", node.name, target.id, item.lineno, said(item.value), None
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            yield path, "function", None, node.name, node.lineno, "\n".join(content.split("\n")[node.lineno - 1 : node.end_lineno]), str(node.col_offset + (9 if isinstance(node, ast.AsyncFunctionDef) else 4))
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute):
                    yield path, "decorated", node.name, said(d.args[0]).strip("'\"") if d.args else "", node.lineno, d.func.attr.upper(), ",".join(said(a.annotation) for a in node.args.args if a.annotation) + "|" + ",".join(said(x) for x in [*node.args.defaults, *node.args.kw_defaults] if x is not None)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            name = said(node.func).rsplit(".", 1)[-1]
            if name in ("path", "re_path", "url", "register") and len(node.args) >= 2:
                yield path, "url", name, said(node.args[0]).strip("r'\""), node.lineno, re.sub(r"\.as_view\(.*", "", said(node.args[1])).rsplit(".", 1)[-1], None
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield path, "import", a.asname, a.name, node.lineno, None, None
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield path, "import", None, node.module, node.lineno, None, None


def extract(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Rows of ``ROW``: one narrow pass over the files, for all languages and kinds.

    Whole files are read; ``max_chars`` leaves what comes later out of files that are not Python. A file that cannot be parsed gives one
    row of kind "error".
    """

    kinds = pa.schema([(n, pa.int32() if n == "line" else pa.string()) for n in ("file", "kind", "owner", "name", "line", "value", "extra")])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                rows = []
                for path, content in zip(*(c.to_pylist() for c in batch.slice(at, FILES_AT_ONCE).columns), strict=True):
                    if content:
                        rows += _python_rows(path, content) if path.endswith(".py") else _regex_rows(path, content[:max_chars])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds.types, strict=True)], schema=kinds)

    return files.select("file_path", "content").mapInArrow(run, ROW)


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row that comes first by file and line."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("file", "line")).alias("r")).select(*keys, "r.*")


#: What a Django model's base holds, and what keeps a class from being one.
MODEL_BASES, NOT_MODELS = r"(?:^|[.,])(?:\w*Model|AbstractUser|AbstractBaseUser|PolymorphicModel|Base|SQLModel|DeclarativeBase)(?:,|$)", r"BaseModel|Serializer|Form|Admin|View|Manager|Filter|Permission|Schema|TestCase|Enum"


def _option(name: str) -> Column:
    return F.regexp_extract("extra", rf"(?:^|\|){name}=([^|]*)", 1)


def models(rows: DataFrame) -> DataFrame:
    """name, file, line, base_classes, has_delete_method, has_soft_delete: the first definition of each name."""
    fielded = rows.filter("kind = 'field'").select("file", F.col("owner").alias("name")).distinct()
    python = rows.filter((F.col("kind") == "class") & F.col("value").rlike(MODEL_BASES) & ~F.col("value").rlike(NOT_MODELS)).join(fielded, ["file", "name"], "left_semi")
    soft = rows.filter((F.col("kind") == "field") & F.col("name").isin("is_deleted", "deleted_at", "is_active", "deleted")).select("file", F.col("owner").alias("name")).distinct().withColumn("soft", F.lit(True))
    both = python.unionByName(rows.filter("kind = 'model'")).join(soft, ["file", "name"], "left")
    out = both.select("name", "file", "line", F.filter(F.split(F.coalesce("value", F.lit("")), ","), lambda x: x != "").alias("base_classes"), F.array_contains(F.split(F.coalesce("extra", F.lit("")), ","), "delete").alias("has_delete_method"), F.coalesce("soft", F.lit(False)).alias("has_soft_delete"))
    return _first(out, "name")


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)


def python_type(suffix: Column, field_type: Column, nullable: Column) -> Column:
    """The Python type of a field. Outside Django an unknown type stands for itself."""
    generic = F.regexp_replace(field_type, r"\??(?:\[\])?\??$", "")
    bare = {"prisma": generic, "java": F.trim(F.substring_index(field_type, "<", 1)), "rust": F.trim(F.regexp_replace(F.replace(field_type, F.lit("Option<")), ">+$", ""))}
    django = _mapped(fixed.FIELD_TYPES["django"], field_type)
    out = F.when(suffix == ".py", F.when(nullable, F.concat(django, F.lit(" | None"))).otherwise(django))
    for end, language in fixed.TYPES_OF_SUFFIX.items():
        if language != "django":
            said = bare.get(language, field_type)
            out = out.when(suffix == end, F.coalesce(_mapped(fixed.FIELD_TYPES[language], said), said))
    return out


def fields(rows: DataFrame) -> DataFrame:
    """model, name, field_type, python_type, is_nullable, is_encrypted, max_length, related_model, on_delete, file, line."""
    f = rows.filter((F.col("kind") == "field") & ~F.coalesce(F.col("value"), F.lit("")).isin("belongs_to", "has_many", "has_one"))
    nullable = F.coalesce((_option("null") == "True") | F.col("value").endswith("?"), F.lit(False))
    suffix = F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1))
    relation = F.col("value").isin("ForeignKey", "OneToOneField", "ManyToManyField")
    return f.select(
        F.col("owner").alias("model"), "name", F.col("value").alias("field_type"), python_type(suffix, F.col("value"), nullable).alias("python_type"), nullable.alias("is_nullable"),
        F.coalesce(F.col("value").isin(*fixed.ENCRYPTED_FIELDS), F.lit(False)).alias("is_encrypted"),
        F.try_to_number(_option("max_length"), F.lit("9999999999")).cast("int").alias("max_length"),
        F.when(relation, F.regexp_extract(F.regexp_replace("extra", "['\"]", ""), r"^(?:to=)?([\w.]+)", 1)).alias("related_model"),
        F.when(_option("on_delete") != "", F.upper(F.regexp_extract(_option("on_delete"), r"(\w+)$", 1))).alias("on_delete"), "file", "line",
    ).dropDuplicates(["file", "model", "name"])


def cascade(expression: Column) -> Column:
    out = None
    for c in fixed.CASCADES:
        hit = F.upper(expression).contains(c)
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return out.otherwise("UNKNOWN")


def title(name: Column) -> Column:
    """Every run of letters with a capital first letter and the others small."""
    pieces = F.regexp_extract_all(name, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def associated_model(association: Column) -> Column:
    return title(F.regexp_replace(association, "s+$", ""))


def delete_paths(rows: DataFrame) -> DataFrame:
    """Foreign keys of Django with an action, and associations of Rails with a dependent option, as edges; PROTECT blocks."""
    f = fields(rows).filter("related_model IS NOT NULL AND on_delete IS NOT NULL")
    django = f.select(F.col("model").alias("source_model"), F.col("name").alias("field_name"), F.substring_index("related_model", ".", -1).alias("target_model"), cascade(F.col("on_delete")).alias("on_delete"), "file", "line")
    rails = rows.filter((F.col("kind") == "field") & F.col("file").endswith(".rb") & F.col("value").isin("belongs_to", "has_many", "has_one"))
    dependent = F.regexp_extract("extra", r"dependent:\s*:(\w+)", 1)
    rails = rails.filter(dependent != "").select(F.col("owner").alias("source_model"), F.col("name").alias("field_name"), associated_model(F.col("name")).alias("target_model"), F.coalesce(_mapped(fixed.DEPENDENT, dependent), F.lit("UNKNOWN")).alias("on_delete"), "file", "line")
    return django.unionByName(rails).withColumn("is_blocker", F.col("on_delete") == "PROTECT")


def join_route(prefix: Column, path: Column) -> Column:
    whole = F.concat(F.lit("/"), F.regexp_replace(F.coalesce(prefix, F.lit("")), "^/+|/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+|/+$", ""))
    clean = F.regexp_replace(F.regexp_replace(whole, "/{2,}", "/"), "(?<=.)/+$", "")
    return clean


def route_path(file: Column, prefix: Column, path: Column) -> Column:
    """A route below its controller's prefix, as each framework joins them; other routes are whole already."""
    before = F.regexp_replace(F.coalesce(prefix, F.lit("")), "^/+|/+$", "")
    joined = F.concat(F.lit("/"), before, F.lit("/"), path)
    plain = F.coalesce(F.nullif(F.regexp_replace(joined, "/+$", ""), F.lit("")), F.lit("/"))
    spring = F.concat(F.lit("/"), F.regexp_replace(joined, "^/+|/+$", ""))
    return F.when(file.rlike(r"\.(?:tsx?|cs)$"), plain).when(file.endswith(".java"), spring).otherwise(path)


def endpoints(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Routes of all languages; Django's registrations meet their views (a router without one offers all five verbs).

    ``names`` (name) are models: the result then has models_read, models_written and models_deleted, for views the models that
    their code names, for FastAPI those in the annotations of their arguments.
    """
    none = F.lit(None).cast("string")
    r = rows.filter("kind = 'route'")
    verb = F.when(F.col("value").isin("ALL", "ANY", "HANDLE", "HANDLEFUNC"), "ANY").otherwise(F.col("value"))
    other = r.select(route_path(F.col("file"), F.col("owner"), F.col("name")).alias("path"), F.array(verb).alias("http_methods"), F.col("extra").alias("handler"), "file", "line", none.alias("viewset_class"), F.lit(False).alias("requires_auth"), none.alias("said"))
    fast = rows.filter((F.col("kind") == "decorated") & F.col("value").isin("GET", "POST", "PUT", "PATCH", "DELETE"))
    fast = fast.select(F.col("name").alias("path"), F.array("value").alias("http_methods"), F.col("owner").alias("handler"), "file", "line", none.alias("viewset_class"), F.col("extra").rlike("(?i)depends.*(user|auth|token)").alias("requires_auth"), F.substring_index("extra", "|", 1).alias("said"))
    views = rows.filter((F.col("kind") == "class") & F.col("value").rlike("View")).groupBy(F.col("name").alias("view")).agg(F.max(F.struct("file", "extra", "value")).alias("v"))
    actions = {"list": "GET", "create": "POST", "retrieve": "GET", "update": "PUT", "partial_update": "PATCH", "destroy": "DELETE", "get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE"}
    verbs = F.array_compact(F.array(*[F.when(F.array_contains(F.split("v.extra", ","), k), v) for k, v in actions.items()]))
    auth = rows.filter((F.col("kind") == "attribute") & (F.col("name") == "permission_classes")).groupBy(F.col("owner").alias("view")).agg(F.bool_or(F.col("value").contains("IsAuthenticated") | F.col("value").contains("IsAdmin")).alias("auth"))
    urls = rows.filter("kind = 'url'").withColumn("view", F.col("value")).join(views, "view", "left").join(auth, "view", "left")
    router = F.col("owner") == "register"
    five = F.array(*map(F.lit, ("GET", "POST", "PUT", "PATCH", "DELETE")))
    default = F.when(router, five).otherwise(F.array(F.lit("ANY")))
    full = F.when(F.col("v.value").contains("ModelViewSet"), five).otherwise(F.array_distinct(F.coalesce(verbs, F.array().cast("array<string>"))))
    path = F.when(router, F.concat(F.lit("/"), "name", F.lit("/"))).otherwise(F.col("name"))
    django = urls.select(path.alias("path"), F.when(F.col("v").isNull() | (F.size(full) == 0), default).otherwise(full).alias("http_methods"), F.col("view").alias("handler"), F.coalesce("v.file", "file").alias("file"), "line", F.col("view").alias("viewset_class"), F.coalesce("auth", F.lit(False)).alias("requires_auth"), none.alias("said"))
    out = other.unionByName(fast).unionByName(django)
    if names is None:
        return out.drop("said")
    said = rows.filter("kind = 'names'").select(F.col("name").alias("viewset_class"), F.explode(F.array_union(F.split("value", ","), F.split("extra", ","))).alias("name"))
    in_view = said.join(names.select("name").distinct(), "name").groupBy("viewset_class").agg(F.array_sort(F.collect_set("name")).alias("in_view"))
    annotated = out.filter("said <> ''").select("said").distinct()
    words = annotated.select("said", F.explode(F.array_distinct(F.split("said", r"\W+"))).alias("name"))
    in_said = words.join(names.select("name").distinct(), "name").groupBy("said").agg(F.array_sort(F.collect_set("name")).alias("in_said"))
    out = out.join(in_view, "viewset_class", "left").join(in_said, "said", "left")
    empty = F.array().cast("array<string>")
    found = lambda *v: F.when(F.arrays_overlap("http_methods", F.array(*map(F.lit, v))), F.coalesce("in_view", empty)).otherwise(empty)
    return out.withColumns({"models_read": F.array_union(found("GET", "ANY"), F.coalesce("in_said", empty)), "models_written": found("POST", "PUT", "PATCH", "ANY"), "models_deleted": found("DELETE")}).drop("said", "in_view", "in_said")


def security_category(module: Column) -> Column:
    """Category of a Python module: a known library by its whole name or its dotted beginning, whatever the case; the first entry wins."""
    name = F.replace(F.lower(module), F.lit("-"), F.lit("_"))
    out = None
    for library, category in fixed.SECURITY_LIBRARIES.items():
        known = library.lower().replace("-", "_")
        hit = (name == known) | F.startswith(name, F.lit(known + "."))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def line_of(content: Column, at: Column) -> Column:
    """Number of the line that holds the character ``at`` (counted as ``instr`` does, not in halves of characters as ``regexp_instr`` does)."""
    before = F.substring(content, F.lit(1), at - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def _at(content: Column, pattern: str) -> Column:
    """The first character of the pattern's leftmost match."""
    return F.length(F.regexp_extract(content, rf"^([\s\S]*?)(?:{pattern})", 1)) + 1


def _longest(pattern: str) -> list[str]:
    """Of each alternative of an import pattern its longest literal run: a match holds one of them. The patterns have no groups."""
    return [max(re.findall(r"[\w/]+", re.sub(r"\\.|\[[^\]]*\]", " ", a)), key=len) for a in pattern.split("|")]


def import_patterns(files: DataFrame) -> DataFrame:
    """module, file, line, category: the first place of each import pattern in every file, by constant regexes in one projection."""
    c, found = F.col("content"), []
    for pattern, category, name in fixed.IMPORT_PATTERNS:
        row = F.struct(F.lit(name).alias("module"), line_of(c, _at(c, pattern)).alias("line"), F.lit(category).alias("category"))
        held = reduce(or_, [c.contains(w) for w in sorted(set(_longest(pattern)))])  # a search for a word costs far less than one for a pattern
        found.append(F.when(held & c.rlike(pattern), row))
    rows = files.select(F.col("file_path").alias("file"), F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    # two patterns may name one library
    return _first(rows.select("module", "file", "line", "category"), "module", "file").select("module", "file", "line", "category")


def libraries(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """module, alias, file, line, category: known Python imports by name, and with ``files`` other languages' by pattern."""
    python = rows.filter("kind = 'import'").withColumn("category", security_category(F.col("name"))).filter("category IS NOT NULL")
    python = _first(python.select(F.col("name").alias("module"), F.col("owner").alias("alias"), "file", "line", "category"), "module", "file").select("module", "alias", "file", "line", "category")
    if files is None:
        return python
    other = import_patterns(files.filter(~F.col("file_path").endswith(".py")))
    return python.unionByName(other.withColumn("alias", F.lit(None).cast("string")))


def merge_models(found: DataFrame, other: DataFrame) -> DataFrame:
    """Full outer merge on name; fields of the second fill a model that has none."""
    a, b = found.select("name", F.col("fields").alias("a")), other.select("name", F.col("fields").alias("b"))
    return a.join(b, "name", "full").select("name", F.when(F.coalesce(F.size("a"), F.lit(0)) > 0, F.col("a")).otherwise(F.coalesce("b", "a")).alias("fields"))


def dominant_language(files: DataFrame) -> DataFrame:
    """The most frequent language; the one seen first on a tie."""
    from ..functions.paths import detect_language

    n = files.withColumn("language", detect_language(F.col("file_path"))).filter("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(1).select("language", "n")


def unaudited_functions(files: DataFrame, full_id: str, name_regex: str, must_not_contain: str, severity: str = "HIGH", message: str = "{file}:{line}") -> DataFrame:
    """The syntax-tree rule: functions whose name matches and whose body lacks what is wanted. Columns count bytes from 1."""
    from ..functions import paths, text

    py = extract(files.filter(F.col("file_path").endswith(".py"))).filter("kind = 'function'").select(F.col("file").alias("file_path"), "name", F.col("line").alias("line_start"), F.col("value").alias("body"), F.col("extra").cast("int").alias("col"))
    js = files.filter(F.lower("file_path").rlike(r"\.jsx?$")).select("file_path", F.explode(F.regexp_extract_all("content", F.lit(r"(?ms)(^[ \t]*(?:export[ \t]+)?(?:async[ \t]+)?function\b.*?(?=^[ \t]*(?:export[ \t]+)?(?:async[ \t]+)?function\b|\z))"), 1)).alias("rest"), "content")
    # a piece goes from one function's header to the next one's; the body ends at the first closing brace that stands as far out as the function
    js = js.withColumn("name", F.regexp_extract("rest", r"^\s*(?:export\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", 1)).filter("name <> ''")
    js = js.select("file_path", "name", line_of(F.col("content"), F.instr("content", F.col("rest"))).alias("line_start"), F.regexp_substr("rest", F.lit(r"(?s)^[^{]*\{.*?(?:\n\}|\}\s*$)")).alias("body"), (F.instr(F.substring_index("rest", "\n", 1), F.concat("name", F.lit("("))) - 1).alias("col"))
    found = py.unionByName(js).filter(F.col("name").rlike(name_regex) & ~F.coalesce(F.col("body"), F.lit("")).rlike(must_not_contain))
    p, test = F.col("file_path"), paths.is_test_file(F.col("file_path"))
    line1 = F.element_at(F.split("body", "\n"), 1)
    from .scan import directive_suppresses

    return found.withColumn("line", F.coalesce(line1, F.lit(""))).filter(~directive_suppresses(F.col("line"), full_id)).select(
        F.lit(full_id).alias("rule_id"), F.when(test & F.lit(severity in ("CRITICAL", "HIGH")), "MEDIUM").otherwise(F.lit(severity)).alias("severity"), "file_path", "line_start", (F.col("col") + 1).alias("col_start"),
        (F.col("col") + 1 + F.octet_length("name")).alias("col_end"), "name", F.replace(F.replace(F.lit(message), F.lit("{file}"), p), F.lit("{line}"), F.col("line_start").cast("string")).alias("message"),
        F.substring(text.strip(F.col("line")), 1, 200).alias("snippet"), paths.confidence(p, paths.AST_CONFIDENCE).alias("confidence"), test.alias("in_test_file"),
    )


def dependency_names(files: DataFrame) -> DataFrame:
    """package, version: what the manifests at the root name, in lower case with underscores; the last version that is given counts."""
    order = {"pyproject.toml": 0, "requirements.txt": 1, "Pipfile": 2, "setup.cfg": 3}
    rows = files.filter(F.col("file_path").isin(*order)).withColumns({"content": F.lower("content"), "seq": _mapped(order, F.col("file_path"))})
    pattern = F.lit(r"""(?m)['"]([\w\-.]+)['"]|^([\w\-.]+)\s*[=><!]""")
    names = rows.select("seq", F.lit(-1).alias("at"), F.explode(F.concat(F.regexp_extract_all("content", pattern, 1), F.regexp_extract_all("content", pattern, 2))).alias("package"), F.lit("").alias("version"))
    lines = rows.select("seq", F.posexplode(F.split("content", "\r?\n")).alias("at", "l")).withColumn("l", F.trim("l"))
    found = r"^([\w\-.]+)\s*[=><!~^]+\s*([\w.]+)"
    versions = lines.select("seq", "at", F.regexp_extract("l", found, 1).alias("package"), F.regexp_extract("l", found, 2).alias("version"))
    both = names.unionByName(versions).withColumn("package", F.replace("package", F.lit("-"), F.lit("_"))).filter("package <> ''")
    return both.groupBy("package").agg(F.max_by("version", F.struct("seq", "at")).alias("version"))


SETTINGS_READ, SETTINGS_SHOWN = 8, 10


def framework(files: DataFrame, settings_read: int | None = SETTINGS_READ, settings_shown: int | None = SETTINGS_SHOWN) -> DataFrame:
    """One row: primary, version, orm, has_drf, has_celery, has_jwt, has_oauth, auth_middleware, settings_files, n_settings, global_auth_required.

    Packages are compared as manifests are read, with underscores; where no manifest tells, an import in a Python file does. Of the settings files, in
    the order of their paths, the first ``settings_read`` are searched and the first ``settings_shown`` are named (None: all). Classes of
    sign-in are in the order in which the files name them.
    """
    deps = dependency_names(files).select(F.collect_list(F.struct("package", "version")).alias("l")).select(F.map_from_entries("l").alias("d"))
    has = lambda *names: F.exists(F.array(*map(F.lit, names)), lambda n: F.map_contains_key("d", n))
    python = files.filter(F.col("file_path").endswith(".py") & ~F.col("file_path").rlike("(?:^|/)(?:" + "|".join(re.escape(d) for d in fixed.PYTHON_SKIP_DIRS) + ")/"))
    known = ("django", "fastapi", "flask")
    imports = python.agg(*[F.coalesce(F.bool_or(F.col("content").contains(f"from {k}") | F.col("content").contains(f"import {k}")), F.lit(False)).alias(f"imports_{k}") for k in known])
    settings = python.filter(F.col("file_path").rlike(r"(?:^|/)settings[^/]*\.py$|(?:^|/)settings/"))
    firsts = lambda n: settings if n is None else settings.orderBy("file_path").limit(n)
    global_auth = F.col("content").contains("IsAuthenticated") & F.col("content").contains("DEFAULT_PERMISSION_CLASSES")
    found = [F.struct(F.min(F.when(F.col("content").contains(a), F.col("file_path"))).alias("file"), F.lit(i).alias("i"), F.lit(a).alias("name")) for i, a in enumerate(fixed.AUTHENTICATION)]
    read = firsts(settings_read).agg(F.coalesce(F.bool_or(global_auth), F.lit(False)).alias("global_auth_required"), F.array(*found).alias("found"))
    read = read.select("global_auth_required", F.transform(F.array_sort(F.filter("found", lambda x: x["file"].isNotNull())), lambda x: x["name"]).alias("auth_middleware"))
    said = read.join(firsts(settings_shown).agg(F.array_sort(F.collect_list("file_path")).alias("settings_files")), F.lit(True)).join(settings.agg(F.count(F.lit(1)).alias("n_settings")), F.lit(True))
    primary = F.when(has("django"), "django").when(has("fastapi"), "fastapi").when(has("flask"), "flask")
    seen = F.when(F.col("imports_django"), "django").when(F.col("imports_fastapi"), "fastapi").when(F.col("imports_flask"), "flask").otherwise("unknown")
    orm = F.when(primary == "django", "django-orm").when((primary == "fastapi") & has("sqlalchemy"), "sqlalchemy").when((primary == "fastapi") & has("tortoise-orm"), "tortoise-orm").when((primary == "flask") & has("sqlalchemy"), "sqlalchemy")
    one = deps.join(imports, F.lit(True)).join(said, F.lit(True))  # one row each
    return one.select(
        F.coalesce(primary, seen).alias("primary"), F.try_element_at("d", primary).alias("version"), orm.alias("orm"), ((primary == "django") & has("djangorestframework")).alias("has_drf"), has("celery").alias("has_celery"),
        has(*fixed.JWT_PACKAGES).alias("has_jwt"), has(*fixed.OAUTH_PACKAGES).alias("has_oauth"), "auth_middleware", "settings_files", "n_settings", "global_auth_required",
    ).withColumn("has_drf", F.coalesce("has_drf", F.lit(False)))


def dependencies(files: DataFrame) -> DataFrame:
    """file_path, package, version from Python manifests anywhere in the tree, package.json and .csproj."""
    py = files.filter(F.col("file_path").rlike(r"(?:^|/)(?:requirements[^/]*\.txt|Pipfile|pyproject\.toml|setup\.cfg)$")).select("file_path", F.explode(F.split("content", "\n")).alias("l"))
    py = py.select("file_path", F.lower(F.regexp_extract("l", r"^\s*['\"]?([A-Za-z][\w.-]*)(?:\[[^\]]*\])?['\"]?\s*(?:[=~<>!^]|$)", 1)).alias("package"), F.regexp_extract("l", r"[=~<>!^]+\s*['\"]?[~^<>=]*([\d][\w.]*)", 1).alias("version")).filter("package <> ''")
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    js = files.filter(F.col("file_path").rlike(r"(?:^|/)package\.json$")).select("file_path", F.explode(F.map_concat(*[F.coalesce(parsed[k], F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies")])).alias("package", "version"))
    js = js.withColumn("version", F.regexp_replace("version", r"^[\^~>=<]+", ""))
    reference = r"""<PackageReference\s+Include="([^"]+)"(?:\s+Version="([^"]*)")?"""
    cs = files.filter(F.col("file_path").endswith(".csproj")).select("file_path", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(reference), 1).alias("package"), F.regexp_extract_all("content", F.lit(reference), 2).alias("version"))).alias("r"))
    return py.unionByName(js).unionByName(cs.select("file_path", "r.package", "r.version"))


def code_tables(files: DataFrame) -> dict[str, DataFrame]:
    """All structural tables from one extraction, stored before its readers start: several that start at once would each extract."""
    rows = stored(extract(files))
    names = models(rows)
    e = endpoints(rows, names)
    return {"files": files, "models": names, "fields": fields(rows), "endpoints": e, "delete_paths": delete_paths(rows), "libraries": libraries(rows, files)}
