"""Queries over the documents as one code base (``sources.services``): structure of all languages, and the sections of the privacy report.

The SQL makes the same files by the templates' own expressions and says by the documents' numbers what stands in them; words that a section
looks for are searched in the files' whole contents, so the documents' texts take part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import SQL, _any, _hits, _in, _quoted, _shown, query, table
from .operators import privacy, structure
from .scratch import stored
from .sources import services

_BREAKS = r"[\r\n\x00\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]+"
_D, _N = services.KINDS, "CAST({} AS INTEGER)"


def _duck(expression: str) -> str:
    return expression.replace("AS STRING)", "AS VARCHAR)")


_BASE = f"""WITH b AS (SELECT doc_id AS d, CAST(doc_id % {_D} AS INTEGER) AS k, doc_id // {_D} AS t, coalesce(text, '') AS text FROM documents),
files AS (SELECT d, k, t, {_duck(services.PATH)} AS file, {_duck(services.CONTENT)} || {services.MARK} || regexp_replace(text, '{_BREAKS}', chr(10) || {services.MARK}, 'g') AS content FROM b),
py AS (SELECT *, file AS file_path FROM files WHERE file LIKE '%.py'),
p0 AS (SELECT * FROM files WHERE k = 0), p1 AS (SELECT * FROM files WHERE k = 1), p2 AS (SELECT * FROM files WHERE k = 2),
models AS (
 SELECT 'Person' || d AS name, file, 4 AS line, t % 5 = 0 AS soft, t % 6 = 1 AS hard FROM p0
 UNION ALL SELECT 'User' || d, file, 1, FALSE, FALSE FROM files WHERE k = 3 UNION ALL SELECT 'Account' || d, file, 1, FALSE, FALSE FROM files WHERE k = 4
 UNION ALL SELECT 'Member' || d, file, 2, FALSE, FALSE FROM files WHERE k = 5 UNION ALL SELECT 'Client' || d, file, 6, FALSE, FALSE FROM files WHERE k = 6
 UNION ALL SELECT 'Row' || d, file, 1, FALSE, FALSE FROM files WHERE k = 7 UNION ALL SELECT 'Doc' || d, file, 2, FALSE, FALSE FROM files WHERE k = 8
 UNION ALL SELECT (CASE t % 4 WHEN 0 THEN 'ConsentRecord' WHEN 1 THEN 'ChildProfile' WHEN 2 THEN 'AuditLog' ELSE 'Ledger' END) || d, file, 2, FALSE, FALSE FROM files WHERE k = 13),
fields AS (
 SELECT 'Person' || d AS model, 'name' AS name, CASE WHEN t % 5 = 2 THEN 'EncryptedCharField' ELSE 'CharField' END AS field_type, file FROM p0 UNION ALL SELECT 'Person' || d, 'owner', 'ForeignKey', file FROM p0
 UNION ALL SELECT 'Person' || d, 'date_of_birth', 'DateField', file FROM p0 WHERE t % 3 = 0 UNION ALL SELECT 'Person' || d, 'delete_after', 'DateTimeField', file FROM p0 WHERE t % 4 = 1 UNION ALL SELECT 'Person' || d, 'is_deleted', 'BooleanField', file FROM p0 WHERE t % 5 = 0
 UNION ALL SELECT 'User' || d, 'email', 'string', file FROM files WHERE k = 3 UNION ALL SELECT 'User' || d, CASE WHEN t % 2 = 0 THEN 'phone' ELSE 'fax' END, 'number', file FROM files WHERE k = 3
 UNION ALL SELECT 'Account' || d, f.n, f.y, file FROM files, (VALUES ('Name', 'string'), ('Size', 'int')) f(n, y) WHERE k = 4 UNION ALL SELECT 'Member' || d, f.n, f.y, file FROM files, (VALUES ('born', 'date'), ('note', 'string')) f(n, y) WHERE k = 5
 UNION ALL SELECT 'Client' || d, f.n, f.y, file FROM files, (VALUES ('Name', 'string'), ('Size', 'int')) f(n, y) WHERE k = 6 UNION ALL SELECT 'Row' || d, f.n, f.y, file FROM files, (VALUES ('name', 'String'), ('size', 'Option<i32>')) f(n, y) WHERE k = 7
 UNION ALL SELECT (CASE t % 4 WHEN 0 THEN 'ConsentRecord' WHEN 1 THEN 'ChildProfile' WHEN 2 THEN 'AuditLog' ELSE 'Ledger' END) || d, 'given', 'BooleanField', file FROM files WHERE k = 13),
routes AS (
 SELECT CASE WHEN t % 2 = 0 THEN '/people' || d || '/' ELSE 'people' || d || '/' END AS path, CASE WHEN t % 2 = 0 THEN 'GET,POST,PUT,PATCH,DELETE' ELSE 'POST' END AS methods, 'Person' || (d - 1) || CASE WHEN t % 2 = 0 THEN 'ViewSet' ELSE 'View' END AS handler, file, 11 AS line, t % 3 = 0 AS auth, t, d - 1 AS person, t % 4 <> 3 AS named, TRUE AS viewed FROM p1
 UNION ALL SELECT '/fast' || d, CASE WHEN t % 3 = 1 THEN 'DELETE' ELSE 'POST' END, 'act' || d, file, 6, t % 4 = 0, t, d - 2, TRUE, FALSE FROM p2
 UNION ALL SELECT '/users' || d || '/:id', CASE WHEN t % 2 = 0 THEN 'DELETE' ELSE 'GET' END, 'act' || d, file, 9, FALSE, t, NULL, FALSE, FALSE FROM files WHERE k = 3
 UNION ALL SELECT '/accounts' || d, CASE WHEN t % 2 = 0 THEN 'DELETE' ELSE 'GET' END, 'drop' || d, file, 6, FALSE, t, NULL, FALSE, FALSE FROM files WHERE k = 4
 UNION ALL SELECT '/members' || d, CASE WHEN t % 2 = 0 THEN 'DELETE' ELSE 'GET' END, '''act' || d || '''', file, 6, FALSE, t, NULL, FALSE, FALSE FROM files WHERE k = 5
 UNION ALL SELECT '/clients' || d || '/{{id}}', CASE WHEN t % 2 = 0 THEN 'DELETE' ELSE 'GET' END, 'Act' || d, file, 3, FALSE, t, NULL, FALSE, FALSE FROM files WHERE k = 6
 UNION ALL SELECT '/docs' || d, CASE WHEN t % 2 = 0 THEN 'DELETE' ELSE 'GET' END, 'act' || d, file, 3, FALSE, t, NULL, FALSE, FALSE FROM files WHERE k = 8
 UNION ALL SELECT '/api' || d || '//x', CASE WHEN t % 2 = 0 THEN 'DELETE' ELSE 'GET' END, 'act' || d, file, 3, FALSE, t, NULL, FALSE, FALSE FROM files WHERE k = 9
 UNION ALL SELECT '/ping' || d, 'GET', 'ping#show', file, 2, FALSE, t, NULL, FALSE, FALSE FROM files WHERE k = 10
 UNION ALL SELECT '/orders' || d, v.verb, 'orders' || d || '#' || v.act, file, 1, FALSE, t, NULL, FALSE, FALSE FROM files, (VALUES ('GET', 'index'), ('GET', 'show'), ('POST', 'create'), ('PUT', 'update'), ('PATCH', 'update'), ('DELETE', 'destroy')) v(verb, act) WHERE k = 10),
said AS (SELECT d, t, CASE t % 4 WHEN 0 THEN 'PII' WHEN 1 THEN 'SENSITIVE_PII' WHEN 2 THEN 'PII' ELSE 'NOT_PII' END AS class FROM p0),
personal AS (SELECT d, t, 'Person' || d AS model FROM said WHERE class <> 'NOT_PII'),
touched AS (
 SELECT r.*, p.model, 'name' AS how FROM routes r JOIN personal p ON p.d = r.person WHERE r.named
 UNION ALL SELECT r.*, p.model, 'view' FROM routes r JOIN personal p ON r.viewed AND contains(lower(r.handler), lower(p.model)))"""


def _tree(spark, sf_dir):
    """The files, written once: their templates are long expressions, which every search for a word would otherwise hold."""
    return stored(services.documents_as_services(table(spark, sf_dir, "documents")).select("file_path", "content"))


def _code(spark, sf_dir):
    return structure.code_tables(_tree(spark, sf_dir))


def _answers(spark, sf_dir):
    """A recorded classification of the model of every person, as the batches of a model give them."""
    t = F.floor(F.col("doc_id") / _D)
    said = F.element_at(F.array(*map(F.lit, ("pii", "Sensitive PII", "PII ", "odd"))), (t % 4).cast("int") + 1)
    field = F.struct(F.lit("name").alias("field_name"), said.alias("classification"), F.lit("r").alias("reason"))
    model = F.struct(F.concat(F.lit("Person"), F.col("doc_id").cast("string")).alias("model_name"), F.array(field).alias("fields"))
    rows = table(spark, sf_dir, "documents").filter(F.col("doc_id") % _D == 0)
    return rows.select(F.to_json(F.struct(F.array(model).alias("models"))).alias("answer"))


def _pii(spark, sf_dir, code):
    return stored(privacy.classified(_answers(spark, sf_dir), code["models"], code["fields"]).select("model", "field", "classification", "reason"))


def _section(analyse, spark, sf_dir, **more):
    code = _code(spark, sf_dir)
    return _shown(analyse(code, _pii(spark, sf_dir, code), **more))


# --- structure -----------------------------------------------------------------------------------------------------------------

@query(f"{_BASE} SELECT name, file, {_N.format('line')} AS line, soft AS has_soft_delete, hard AS has_delete_method FROM models")
def services_models(spark, sf_dir):
    return _code(spark, sf_dir)["models"].select("name", "file", "line", "has_soft_delete", F.coalesce("has_delete_method", F.lit(False)).alias("has_delete_method"))


@query(f"{_BASE} SELECT model, name, field_type, file FROM fields")
def services_fields(spark, sf_dir):
    return _code(spark, sf_dir)["fields"].select("model", "name", "field_type", "file")


@query(f"{_BASE} SELECT path, methods, handler, file, {_N.format('line')} AS line, auth AS requires_auth FROM routes")
def routes_of_code(spark, sf_dir):
    return _code(spark, sf_dir)["endpoints"].select("path", F.array_join("http_methods", ",").alias("methods"), "handler", "file", "line", "requires_auth")


@query(f"{_BASE} SELECT DISTINCT path, model FROM touched WHERE contains(methods, 'DELETE')")
def endpoints_of_models(spark, sf_dir):
    """DELETE endpoints with the personal models that they touch, by name or by view."""
    code = _code(spark, sf_dir)
    personal = privacy.pii_models(_pii(spark, sf_dir, code)).select("model")
    return privacy.touching(code["endpoints"].filter(F.array_contains("http_methods", "DELETE")), personal).select("path", "model").distinct()


@query(f"{_BASE} SELECT model FROM personal WHERE model NOT IN (SELECT model FROM touched WHERE contains(methods, 'DELETE'))")
def erasure_coverage(spark, sf_dir):
    """Personal models that no DELETE endpoint covers."""
    code = _code(spark, sf_dir)
    personal = privacy.pii_models(_pii(spark, sf_dir, code)).select("model")
    covered = privacy.touching(code["endpoints"].filter(F.array_contains("http_methods", "DELETE")), personal).select("model").distinct()
    return personal.join(covered, "model", "left_anti")


# --- sections --------------------------------------------------------------------------------------------------------------------

def _top(what: str, rows: str, n: int) -> str:
    return f"(SELECT coalesce(list(v ORDER BY v), []) FROM (SELECT DISTINCT {what} AS v FROM {rows} ORDER BY 1 LIMIT {n}))"


def _whether(test: str, said: str) -> str:
    return f"CASE WHEN {test} THEN [{said}] ELSE [] END"


def _row(section: str, status: str, evidence: list[str], blockers: list[str]) -> str:
    many = lambda lists: "array_to_string(" + " || ".join(f"CAST({x} AS VARCHAR[])" for x in lists) + ", '|')"
    return f"SELECT {_quoted(section)} AS section, {status} AS status, {many(evidence)} AS evidence, {many(blockers)} AS blockers"


_NO = "[]"
_BLOCKED = "(SELECT 'Person' || p0.d || '.owner keeps Person' || (p0.d + 14) AS v FROM p0 JOIN personal x ON x.d = p0.d + 14 WHERE p0.t % 2 = 1)"


@query(f"""{_BASE}, n AS (SELECT (SELECT count(*) FROM touched WHERE contains(methods, 'DELETE')) AS deletes, (SELECT count(*) FROM touched WHERE contains(methods, 'DELETE') AND NOT auth) AS open,
 (SELECT count(*) FROM p0 JOIN personal x ON x.d = p0.d + 14 WHERE p0.t % 2 = 0) AS cascades, (SELECT count(*) FROM models WHERE hard AND name IN (SELECT model FROM personal)) AS hard)
""" + _row("§7(3)", "'UNKNOWN'", [
    "[deletes || ' ways to delete personal models', open || ' of them open to all', cascades || ' cascading paths', hard || ' models with a method of their own']", _top("'DELETE ' || path", "touched WHERE contains(methods, 'DELETE')", 10),
    _top("'deleted softly: ' || name", "models WHERE soft AND name IN (SELECT model FROM personal)", 10), _top("'no DELETE for ' || model", "personal WHERE model NOT IN (SELECT model FROM touched WHERE contains(methods, 'DELETE'))", 10),
], [_top("v", _BLOCKED, 10)]) + " FROM n")
def erasure_section(spark, sf_dir):
    return _section(privacy.erasure, spark, sf_dir)


_WORDS = " + ".join(f"len(regexp_extract_all(content, '(?i){p}'))" for p in privacy.CONSENT)
_TAKES = "(SELECT * FROM touched r WHERE contains(methods, 'POST') AND (how = 'name' OR NOT EXISTS (SELECT 1 FROM touched o WHERE o.path = r.path AND o.how = 'name')))"


@query(f"""{_BASE}, takes AS {_TAKES},
m AS (SELECT file, {_WORDS} AS n, regexp_matches(content, 'consent_?middleware', 'i') AS middleware FROM py WHERE file IN (SELECT file FROM takes)
 UNION ALL SELECT file, 1, TRUE FROM py WHERE k = 11 AND regexp_matches(content, 'ConsentMiddleware|consent_required', 'i')),
w AS (SELECT * FROM m WHERE n > 0),
n AS (SELECT (SELECT count(*) FROM models WHERE contains(lower(name), 'consent')) AS models, (SELECT count(DISTINCT path) FROM takes) AS posts, (SELECT coalesce(sum(n), 0) FROM w) AS words, (SELECT coalesce(bool_or(middleware), FALSE) FROM w) AS middleware)
""" + _row("§4", "'UNKNOWN'", [
    "[models || ' models of consent', posts || ' endpoints take personal data', CAST(words AS BIGINT) || ' mentions of consent']", _top("'model: ' || name", "models WHERE contains(lower(name), 'consent')", 10), _top("path || ' takes ' || model", "takes", 5),
    _top("'mentions in ' || v", "(SELECT file || ': ' || n AS v FROM w ORDER BY 1 LIMIT 10)", 10), _whether("middleware", "'Consent is asked for on the way in.'"),
], [_whether("posts > 0 AND words = 0", "'Personal data is taken in where consent is never mentioned.'")]) + " FROM n")
def consent_section(spark, sf_dir):
    return _section(privacy.consent, spark, sf_dir)


_ENDS = "fields WHERE name = 'delete_after' AND model IN (SELECT model FROM personal)"
_COMMAND = _hits(privacy.MANAGEMENT).replace(chr(92) + "(", "[(]").replace(chr(92) + ")", "[)]")


@query(f"""{_BASE}, h AS (SELECT file_path, {_hits(privacy.RETENTION_POLICY)} AS policy, {_hits(privacy.SCHEDULERS)} AS scheduler, CASE WHEN contains(file_path, 'management/commands/') THEN {_COMMAND} END AS command FROM py),
n AS (SELECT (SELECT count(*) FROM {_ENDS}) AS fields, count(policy) AS policies, count(scheduler) AS schedulers FROM h)
""" + _row("§8(5)", "CASE WHEN fields > 0 OR policies > 0 THEN 'PARTIAL' ELSE 'NON_COMPLIANT' END", [
    _top("'ends: ' || model || '.' || name", _ENDS, 10), f"CASE WHEN fields = 0 THEN {_top(chr(39) + 'ends elsewhere: ' + chr(39) + ' || model || ' + chr(39) + '.' + chr(39) + ' || name', 'fields WHERE name = ' + chr(39) + 'delete_after' + chr(39), 5)} ELSE [] END",
    _top("'policy: ' || file_path || ':' || policy", "h WHERE policy IS NOT NULL", 5), _top("'schedule: ' || file_path || ':' || scheduler", "h WHERE scheduler IS NOT NULL", 5), _top("'command: ' || file_path", "h WHERE command IS NOT NULL", 5),
    _top("'deleted softly: ' || name", "models WHERE soft AND name IN (SELECT model FROM personal)", 10),
], [_whether("fields = 0", "'No personal model has a field that ends its records.'"), _whether("schedulers = 0 AND policies = 0", "'Nothing purges old records.'")]) + " FROM n")
def retention_status(spark, sf_dir):
    return _section(privacy.retention, spark, sf_dir)


@query(f"""{_BASE}, h AS (SELECT file_path, {_hits(privacy.BREACH)} AS breach, regexp_matches(content, '{privacy.NOTIFICATION[0]}', 'i') AS mail FROM py),
a AS (SELECT 'sentry_sdk in ' || file AS alert FROM files WHERE k = 12 AND t % 6 = 5 UNION ALL SELECT 'configured in ' || file FROM files WHERE k = 11 AND regexp_matches(content, 'SENTRY_DSN|sentry_sdk[.]init|PAGERDUTY|OPSGENIE|DATADOG', 'i')),
n AS (SELECT (SELECT count(*) FROM a) AS alerting, (SELECT count(*) FROM files WHERE k = 12 AND t % 6 = 5) AS logging, count(breach) AS breach, count(*) FILTER (mail) AS mails, (SELECT count(*) FROM models WHERE name LIKE 'AuditLog%') AS audits FROM h)
""" + _row("§8(6)", "CASE WHEN alerting > 0 OR audits > 0 THEN 'PARTIAL' ELSE 'NON_COMPLIANT' END", [
    _top("'alerting: ' || alert", "a", 5), _top("'audit log: ' || name", "models WHERE name LIKE 'AuditLog%'", 5), _top("'breach: ' || file_path || ':' || breach", "h WHERE breach IS NOT NULL", 5),
    _whether("logging > 0", "logging || ' imports of logging'"), _whether("mails > 0", "'Messages can be sent.'"),
], [_whether("breach = 0", "'Nothing in the code handles a breach.'"), _whether("alerting = 0", "'No alerting: a breach may go unseen.'")]) + " FROM n")
def breach_status(spark, sf_dir):
    return _section(privacy.breach, spark, sf_dir)


_AGES = "fields WHERE name = 'date_of_birth' AND model IN (SELECT model FROM personal)"


@query(f"""{_BASE}, h AS (SELECT file_path, {_hits(privacy.CHILD)} AS first, {_hits(privacy.AGE_GATE)} AS gate FROM py),
s AS (SELECT *, regexp_matches(first, ': .*(?:parental|guardian)', 'i') AS parental FROM h WHERE first IS NOT NULL OR gate IS NOT NULL),
c AS (SELECT count(*) AS kids FROM models WHERE regexp_matches(lower(name), '{"|".join(privacy.CHILD_MODELS)}')),
n AS (SELECT (SELECT count(*) FROM {_AGES}) AS ages, c.kids, count(gate) AS gates, count(*) FILTER (parental) AS parental FROM s, c GROUP BY c.kids)
""" + _row("§9", "CASE WHEN ages = 0 AND kids = 0 THEN 'COMPLIANT' WHEN gates > 0 AND parental > 0 THEN 'PARTIAL' WHEN ages > 0 AND gates = 0 THEN 'NON_COMPLIANT' ELSE 'PARTIAL' END", [
    _top("'age: ' || model || '.' || name", _AGES, 10), _top("'model: ' || name", f"models WHERE regexp_matches(lower(name), '{'|'.join(privacy.CHILD_MODELS)}')", 10), _top("'check: ' || file_path || ':' || gate", "s WHERE gate IS NOT NULL", 5),
    _top("'parents asked: ' || file_path", "s WHERE parental", 5), _top("'mention: ' || file_path || ':' || first", "s WHERE NOT parental AND first IS NOT NULL", 5),
], [_whether("ages > 0 AND gates = 0", "'Ages are kept but never checked.'"), _whether("(ages > 0 OR kids > 0) AND parental = 0", "'No parent''s consent is asked for.'")]) + " FROM n")
def children_status(spark, sf_dir):
    return _section(privacy.children, spark, sf_dir)


_SETTINGS = "files WHERE k = 11"


@query(f"""{_BASE}, s AS (SELECT * FROM {_SETTINGS})
SELECT count(*) AS n_settings, bool_or(contains(content, 'IsAuthenticated') AND contains(content, 'DEFAULT_PERMISSION_CLASSES')) AS global_auth_required,
 (SELECT string_agg(name, ',' ORDER BY f) FROM (SELECT a.name, min(s.file) AS f FROM s JOIN (VALUES ('SessionAuthentication'), ('JWTAuthentication')) a(name) ON contains(s.content, a.name) GROUP BY 1)) AS auth FROM s""")
def settings_of_code(spark, sf_dir):
    """What all settings files of the tree say together, whatever their number."""
    out = structure.framework(_tree(spark, sf_dir), settings_read=None)
    return out.select("n_settings", "global_auth_required", F.array_join("auth_middleware", ",").alias("auth"))


_KEPT_LITTLE = f"""{_BASE}, c AS (SELECT 'Person' || d AS model, count(*) AS n FROM said WHERE class <> 'NOT_PII' GROUP BY 1)
""" + _row("§5", "'UNKNOWN'", [_top("model || ': ' || n", "c", 10)], [_NO])


@query(" UNION ALL ".join(f"SELECT * FROM ({part})" for part in (SQL["consent_section"], _KEPT_LITTLE, SQL["erasure_section"])))
def judged_sections(spark, sf_dir):
    """The sections that are handed to a judgement: consent, how little is kept (personal models with their numbers of fields), erasure."""
    code = _code(spark, sf_dir)
    return _shown(privacy.report(code, _pii(spark, sf_dir, code), (privacy.consent, privacy.minimisation, privacy.erasure)))
