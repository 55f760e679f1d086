"""Queries of rules that read more than lines: syntax trees, flows of values, versions; and bodies by their lexical states.

The documents become programs and manifests that hold their texts (``sources.files``), so the work grows with the tables. The SQL
knows what each document's program says by the document's number, and counts the lines of its text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _packs, query, table
from .functions import text
from .operators import dependencies, structure, syntax, taint
from .sources import files as src
from .streaming import events as stream

_BREAKS = r"[\r\n\x00\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]+"
_NAMES = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(src.PROGRAM_NAMES)) + " END"
_MONEY = "regexp_matches(name, 'transfer|repay|debit|credit')"
_PROGRAMS = f"""WITH p AS (
 SELECT doc_id AS d, len(regexp_extract_all(coalesce(text, ''), '{_BREAKS}')) + 1 AS head, {_NAMES} AS name, CAST(doc_id % 6 AS INTEGER) AS k, doc_id % 4 = 3 AS js,
  CASE WHEN doc_id % 4 = 3 THEN 'web/desk' || doc_id || '.js' ELSE 'svc/desk' || doc_id || '.py' END AS file_path FROM documents)"""


def _programs(spark, sf_dir):
    return src.documents_as_programs(table(spark, sf_dir, "documents")).select("file_path", "content")


@query(f"""{_PROGRAMS}
SELECT 'generic/transport/money-without-audit' AS rule_id, file_path, CAST(head + 6 AS INTEGER) AS line_start, 9 AS col_start, CAST(9 + length(name) AS INTEGER) AS col_end, 'HIGH' AS severity, 'def ' || name || '(self, amount):' AS snippet, CAST(0.9 AS DOUBLE) AS confidence
 FROM p WHERE NOT js AND {_MONEY} AND d % 4 <> 0
UNION ALL SELECT 'generic/transport/money-without-audit-script', file_path, CAST(head + 2 AS INTEGER), 10, CAST(10 + length(name) AS INTEGER), 'HIGH', 'function ' || name || '(amount) {{', CAST(0.9 AS DOUBLE) FROM p WHERE js AND {_MONEY} AND d % 8 <> 3
UNION ALL SELECT 'generic/transport/object-from-bytes', file_path, CAST(head + 9 AS INTEGER), 23, 28, 'CRITICAL', 'return pickle.loads(amount)', CAST(0.9 AS DOUBLE) FROM p WHERE NOT js AND d % 3 = 0 AND d % 2 = 0""")
def tree_rules(spark, sf_dir):
    """All rules of type ``ast``. A word that only a string holds is in the body all the same."""
    out = syntax.scan_trees(_programs(spark, sf_dir), list(_packs()))
    return out.select("rule_id", "file_path", "line_start", "col_start", "col_end", "severity", "snippet", "confidence")


_NODES = f"""{_PROGRAMS}
SELECT 'function_definition' AS kind, 'name' AS role, count(*) * 2 AS n FROM p WHERE NOT js
UNION ALL SELECT 'class_definition', 'name', count(*) FROM p WHERE NOT js
UNION ALL SELECT 'function_declaration', 'name', count(*) FROM p WHERE js
UNION ALL SELECT 'assignment', 'left', sum(1 + k + CASE WHEN d % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN d % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN d % 7 = 0 THEN 1 ELSE 0 END) FROM p WHERE NOT js"""


@query(_NODES)
def tree_nodes(spark, sf_dir):
    """How often a node of a kind fills a field of its parent: a join of the node table with itself."""
    nodes = syntax.nodes(_programs(spark, sf_dir))
    kids = nodes.filter(F.col("field").isin("name", "left")).select("file_path", F.col("parent").alias("id"), F.col("field").alias("role"))
    wanted = nodes.filter(F.col("kind").isin("function_definition", "class_definition", "function_declaration", "assignment"))
    return wanted.join(kids, ["file_path", "id"]).groupBy("kind", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_PROGRAMS}, g AS (SELECT *, head + CASE WHEN d % 3 = 0 THEN 1 ELSE 0 END + 13 + k + CASE WHEN d % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN d % 7 = 0 THEN 1 ELSE 0 END AS line FROM p WHERE NOT js AND d % 5 <> 0 AND d % 7 <> 0 AND d % 11 <> 0)
SELECT 'generic/transport/address-from-request' AS rule_id, file_path, CAST(line AS INTEGER) AS line_start, 12 AS col_start, CAST(12 + length('redirect(v' || k || ')') AS INTEGER) AS col_end, 'a request decides where ' || file_path || ':' || line || ' leads' AS message FROM g""")
def taint_flows(spark, sf_dir):
    out = taint.scan_flows(_programs(spark, sf_dir), list(_packs()))
    return out.select("rule_id", "file_path", "line_start", "col_start", "col_end", "message")


_FLAT = [(v, i) for i, same in enumerate(src.MANIFEST_VERSIONS) for v in same]
_AT = {v: i for v, i in _FLAT}
_PLACES = "(VALUES " + ", ".join(f"({i}, '{v}', {rank if v else 'NULL'})" for i, (v, rank) in enumerate(_FLAT)) + ") AS v(i, version, rank)"
_MANIFESTS = f"""WITH v AS (SELECT * FROM {_PLACES}),
m AS (SELECT doc_id AS d, doc_id % 3 = 2 AS js, doc_id % {len(_FLAT)} AS i1, (doc_id + 5) % {len(_FLAT)} AS i2, (doc_id + 9) % {len(_FLAT)} AS i3 FROM documents),
r AS (
 SELECT d, js, 1 AS n, CASE WHEN js THEN 'flask' ELSE 'Flask' END AS package, v.* FROM m JOIN v ON v.i = m.i1
 UNION ALL SELECT d, js, 2, CASE WHEN js THEN 'lodash' ELSE 'old_Lib' END, v.* FROM m JOIN v ON v.i = m.i2
 UNION ALL SELECT d, js, 3, CASE WHEN js THEN 'left-pad' ELSE 'other-lib' END, v.* FROM m JOIN v ON v.i = m.i3),
w AS (SELECT *, CASE WHEN js THEN 'svc' || d || '/package.json' ELSE 'svc' || d || '/requirements.txt' END AS file_path, CAST(CASE WHEN js THEN 3 + n + CASE WHEN n = 3 THEN 1 ELSE 0 END ELSE n + 1 END AS INTEGER) AS line_start, CASE version WHEN 'v2' THEN CASE WHEN js THEN '2' ELSE version END WHEN '' THEN NULL ELSE version END AS said FROM r)"""


def _manifests(spark, sf_dir):
    return src.documents_as_manifests(table(spark, sf_dir, "documents")).select("file_path", "content")


@query(f"""{_MANIFESTS}
SELECT CASE WHEN js OR n = 1 THEN 'generic/transport/known-weak' ELSE 'generic/transport/old-lib' END AS rule_id, file_path, line_start, CASE WHEN js OR n = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 package || coalesce(' ' || said, '') || CASE WHEN js OR n = 1 THEN ' at ' || file_path || ':' || line_start ELSE '' END || ': ' || CASE WHEN js THEN CASE n WHEN 1 THEN 'has no owner' WHEN 2 THEN 'lets prototypes be changed' ELSE 'is gone' END ELSE CASE n WHEN 1 THEN 'leaks its session key' ELSE 'is old too' END END AS message
FROM w WHERE CASE WHEN js THEN CASE n WHEN 1 THEN rank < {_AT['1.10']} WHEN 2 THEN rank <= {_AT['1.0.1']} ELSE TRUE END
 ELSE CASE n WHEN 1 THEN rank <= {_AT['1.0']} WHEN 3 THEN rank <= {_AT['1.0.post1']} ELSE FALSE END END""")
def dependency_rules(spark, sf_dir):
    """All rules of type ``dependency`` over the manifests; the declarations of one library carry a directive."""
    return dependencies.scan_dependencies(_manifests(spark, sf_dir), list(_packs())).select("rule_id", "file_path", "line_start", "severity", "message")


@query(f"""{_MANIFESTS} SELECT file_path, CASE WHEN js THEN 'javascript' ELSE 'python' END AS language, package, said AS version, line_start AS line_no FROM w""")
def dependencies_declared(spark, sf_dir):
    return dependencies.declared(_manifests(spark, sf_dir)).select("file_path", "language", "package", "version", "line_no")


@query("""WITH r AS (SELECT doc_id AS d, 'models/m' || doc_id || '.js' AS file FROM documents)
SELECT file, 'M' || d AS model, 'a' AS name, 'STRING' AS field_type FROM r UNION ALL SELECT file, 'M' || d, 'b', CASE WHEN d % 2 = 0 THEN 'TEXT' ELSE 'JSONB' END FROM r
UNION ALL SELECT file, 'M' || d, 'c', CASE WHEN d % 3 = 0 THEN 'DATE' ELSE 'UUID' END FROM r UNION ALL SELECT file, 'M' || d, 'e', 'ENUM' FROM r""")
def lexed_bodies(spark, sf_dir):
    """Fields of models whose bodies hold brackets in comments, strings and templates, and the document's text in a comment."""
    rows = structure.extract(src.documents_as_braces(table(spark, sf_dir, "documents")).select("file_path", "content"))
    return structure.fields(rows).select("file", "model", "name", "field_type")


_WORDS = "[A-Za-z]+(?:tion|ment)s?"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS found, regexp_split_to_array(text, '{_WORDS}') AS gaps FROM d WHERE regexp_matches(text, '{_WORDS}')),
x AS (SELECT doc_id, unnest(range(len(found))) AS nth, unnest(found) AS match, unnest(gaps[1:len(found)]) AS gap FROM m),
w AS (SELECT *, coalesce(sum(length(gap) + length(match)) OVER b, 0) + length(gap) + 1 AS place, coalesce(sum(length(gap) - length(replace(gap, chr(10), ''))) OVER b, 0) + length(gap) - length(replace(gap, chr(10), '')) + 1 AS line FROM x WINDOW b AS (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(nth AS INTEGER) AS nth, CAST(place AS INTEGER) AS "at", CAST(line AS INTEGER) AS line, match FROM w""")
def all_matches(spark, sf_dir):
    """Every match of a pattern in every document, with its letter and line."""
    return text.all_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", _WORDS)


# --- deliveries and installations --------------------------------------------------------------------------------------------------


def _deliveries(spark, sf_dir):
    """Every event as a delivery: one in nine is of an installation, the others ask for a scan."""
    e = table(spark, sf_dir, "events").withColumn("inst", F.col("user_id") % 40)
    action = F.element_at(F.array(*map(F.lit, ("created", "suspend", "unsuspend", "deleted", "other"))), (F.floor(F.col("event_id") / 9) % 5).cast("int") + 1)
    install = F.to_json(F.struct(action.alias("action"), F.struct(F.col("inst").alias("id")).alias("installation")))
    draft = F.col("event_id") % 5 == 0
    request = F.to_json(F.struct(F.lit("opened").alias("action"), F.struct(F.lit("open").alias("state"), draft.alias("draft"), F.col("event_id").cast("int").alias("number")).alias("pull_request"), F.struct(F.col("inst").alias("id")).alias("installation")))
    is_install = F.col("event_id") % 9 == 0
    return e.select(F.when(is_install, "installation").otherwise("pull_request").alias("kind"), F.when(is_install, install).otherwise(request).alias("value"), "ts")


@query("""WITH e AS (SELECT event_id, ts, user_id % 40 AS inst FROM events),
l AS (SELECT inst, ts, max(CASE event_id // 9 % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END) AS status FROM e WHERE event_id % 9 = 0 AND event_id // 9 % 5 <> 4 GROUP BY 1, 2),
r AS (SELECT event_id, ts, inst FROM e WHERE event_id % 9 <> 0 AND event_id % 5 <> 0)
SELECT CAST(r.event_id AS INTEGER) AS number, r.inst AS installation_id, r.ts FROM r ASOF JOIN l ON r.inst = l.inst AND r.ts >= l.ts WHERE l.status = 0""")
def authorised_requests(spark, sf_dir):
    """Requests of installations that are active at their time."""
    raw = _deliveries(spark, sf_dir)
    asked = stream.parse(raw.filter("kind = 'pull_request'")).filter(stream.should_scan())
    asked = asked.select(F.col("event.pull_request.number").alias("number"), F.col("event.installation.id").alias("installation_id"), "ts")
    return stream.authorised(asked, stream.installation_log(raw))
