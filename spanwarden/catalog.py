"""All registered queries of the library and, for each, the SQL that gives the same rows.

The documents become a made-up file tree (``sources.files.documents_as_files``), so the scan runs on the given tables.
Every query reads its whole tables; those over ``_tree`` read the documents' numbers and lengths, not their texts.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .operators import judged, privacy, reports, rules, scan, structure
from .schemas import SEVERITIES, severity_rank
from .sources import files as src
from .streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the corpus as files -------------------------------------------------------------------------------------------

MARKS = {1: " # noqa", 2: " # noqa: corpus/exposure/email", 3: " // scan:disable=card-number, licence-line", 4: " # scan:disable"}


def _case(on: str, values, otherwise: str | None = None) -> str:
    pairs = values.items() if isinstance(values, dict) else enumerate(values)
    return f"CASE {on} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in pairs) + (f" ELSE '{otherwise}'" if otherwise is not None else "") + " END"


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}', 'i')" for p in patterns) + ")"


_PATH = f"{_case('doc_id % 5', src._DIRS)} || '/' || source || '/doc_' || doc_id || {_case('doc_id % 6', src._SUFFIXES)}"
_LANG = "CASE regexp_extract(file_path, '([.][^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items()) + " END"
_TEST, _MIGRATION = _any("file_path", paths.TEST_PATHS), _any("file_path", paths.MIGRATION_PATHS)
_CONF = f"CASE WHEN {_TEST} THEN CAST(0.3 AS DOUBLE) WHEN {_MIGRATION} THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END"
_SPLIT = r"regexp_split_to_array(coalesce(content, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')"
_FILES = f"WITH files AS (SELECT doc_id, {_PATH} AS file_path, text AS content FROM documents),\nctx AS (SELECT *, {_LANG} AS language, {_TEST} AS in_test_file, {_CONF} AS confidence FROM files)"
_LINES = f"""{_FILES},
parts AS (SELECT *, {_SPLIT} AS p0 FROM ctx),
cut AS (SELECT *, CASE WHEN p0[len(p0)] = '' THEN p0[1:len(p0) - 1] ELSE p0 END AS p FROM parts),
plain AS (SELECT doc_id, file_path, language, in_test_file, confidence, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM cut),
lines AS (SELECT doc_id, file_path, language, in_test_file, confidence, CAST(line_no AS INTEGER) AS line_no, line || {_case('doc_id % 7', MARKS, '')} AS line FROM plain)"""


@lru_cache
def _packs() -> tuple[rules.Pack, ...]:
    return tuple(rules.load_pack_directory(Path(__file__).parent / "packs"))


def _exposure() -> rules.Pack:
    return next(p for p in _packs() if p.id == "corpus/exposure")


def _files(spark, sf_dir) -> DataFrame:
    return src.documents_as_files(table(spark, sf_dir, "documents"))


def _marked_lines(spark, sf_dir) -> DataFrame:
    lines = text.explode_lines(scan.with_context(_files(spark, sf_dir)))
    mark = None
    for k, v in MARKS.items():
        mark = F.when(F.col("doc_id") % 7 == k, v) if mark is None else mark.when(F.col("doc_id") % 7 == k, v)
    return lines.withColumn("line", F.concat("line", mark.otherwise("")))


def _violations(spark, sf_dir) -> DataFrame:
    return scan.scan(_files(spark, sf_dir), [_exposure()], lines=_marked_lines(spark, sf_dir))


def _quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _rule_sql(pack: rules.Pack, rule: rules.Rule, seq: int) -> str:
    full = pack.full_id(rule)
    match = "CASE " + " ".join(f"WHEN regexp_matches(line, {_quoted(p)}, 'i') THEN regexp_extract(line, {_quoted(p)}, 0, 'i')" for p in rule.patterns) + " END"
    where = ["(" + " OR ".join(f"regexp_matches(line, {_quoted(p)}, 'i')" for p in rule.patterns) + ")"]
    where += [f"NOT regexp_matches(line, {_quoted(p)}, 'i')" for p in rule.exclude_patterns]
    if rule.skip_tests:
        where.append("NOT in_test_file")
    if "*" not in rule.languages:
        where.append("language IN (" + ", ".join(map(_quoted, rule.languages)) + ")")
    slug = rule.id
    for head, ids in ((r"(?:#|//)\s*noqa(?::\s*([\w/,.\-\s]+))?", [full]), (r"(?:#|//)\s*scan:disable(?:=\s*([\w/,.\-\s]+))?", [full, slug])):
        named = f"regexp_extract(line, '{head}', 1, 'i')"
        hit = " OR ".join(f"list_contains(list_transform(string_split({named}, ','), lambda x: trim(x)), {_quoted(i)})" for i in ids)
        where.append(f"NOT (regexp_matches(line, '{head}', 'i') AND ({named} = '' OR {hit}))")
    secret = text.redacts(rule.id, rule.tags)
    shown = "'[REDACTED]'" if secret else "m"
    message = f"replace(replace(replace({_quoted(rule.message)}, '{{file}}', file_path), '{{line}}', CAST(line_no AS VARCHAR)), '{{match}}', {shown})"
    snippet = "left(line, col_start - 1) || '[REDACTED]' || substr(line, col_start + length(m))" if secret else "line"
    severity = "CASE WHEN in_test_file THEN 'MEDIUM' ELSE " + _quoted(rule.severity) + " END" if SEVERITIES.index(rule.severity) < 2 else _quoted(rule.severity)
    return f"""SELECT {seq} AS rule_seq, '{full}' AS rule_id, {_quoted(rule.name)} AS rule_name, {severity} AS severity, file_path, line_no AS line_start, CAST(col_start AS INTEGER) AS col_start, CAST(col_start + length(m) AS INTEGER) AS col_end,
 {message} AS message, left(regexp_replace({snippet}, '^\\s+|\\s+$', '', 'g'), 200) AS snippet, {_quoted(rule.fix_hint)} AS fix_hint, confidence, in_test_file
 FROM (SELECT *, strpos(line, m) AS col_start FROM (SELECT *, {match} AS m FROM lines WHERE {' AND '.join(where)}))"""


_V = _LINES + ",\nv AS (\n" + "\nUNION ALL\n".join(_rule_sql(_exposure(), r, i) for i, r in enumerate(_exposure().rules)) + ")"
_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + " END"
_FINGER = r"substr(sha256(rule_id || '|' || replace(file_path, '\', '/') || '|' || lower(regexp_replace(snippet, '^\s+|\s+$', '', 'g'))), 1, 16)"


# --- path functions ---------------------------------------------------------------------------------------------------

@query(f"{_FILES} SELECT file_path, language FROM ctx")
def detect_language(spark, sf_dir):
    return _files(spark, sf_dir).select("file_path", paths.detect_language(F.col("file_path")).alias("language"))


@query(f"{_FILES} SELECT file_path, in_test_file FROM ctx")
def is_test_file(spark, sf_dir):
    return _files(spark, sf_dir).select("file_path", paths.is_test_file(F.col("file_path")).alias("in_test_file"))


@query(f"{_FILES} SELECT file_path, {_MIGRATION} AS is_migration FROM ctx")
def migration_file(spark, sf_dir):
    return _files(spark, sf_dir).select("file_path", paths.is_migration_file(F.col("file_path")).alias("is_migration"))


@query(f"{_FILES} SELECT file_path, confidence FROM ctx")
def confidence(spark, sf_dir):
    return _files(spark, sf_dir).select("file_path", paths.confidence(F.col("file_path")).alias("confidence"))


@query(f"{_FILES} SELECT file_path, " + " OR ".join(f"regexp_full_match(file_path, '{paths.glob_regex(g)}')" for g in paths.IGNORED) + " AS ignored FROM ctx")
def ignored_paths(spark, sf_dir):
    return _files(spark, sf_dir).select("file_path", paths.is_ignored(F.col("file_path")).alias("ignored"))


@query(f"{_FILES} SELECT language, count(*) AS n FROM ctx WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(file_path) LIMIT 1")
def dominant_language(spark, sf_dir):
    return structure.dominant_language(_files(spark, sf_dir))


# --- lines and the rule scan ------------------------------------------------------------------------------------------

@query(f"{_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM plain")
def lines_explode(spark, sf_dir):
    return text.explode_lines(_files(spark, sf_dir), "content", "doc_id")


@query(f"{_LINES} SELECT file_path, string_agg(printf('%4d | %s', line_no, line), chr(10) ORDER BY line_no) AS numbered FROM (SELECT file_path, line_no, line FROM plain) GROUP BY 1")
def numbered_source(spark, sf_dir):
    return text.numbered(text.explode_lines(_files(spark, sf_dir), "content", "file_path"), "file_path")


@query(f"{_FILES} SELECT file_path, CAST(length(content) // 4 AS INTEGER) AS tokens FROM files WHERE length(content) // 4 <= 4000")
def token_budget(spark, sf_dir):
    return judged.within_budget(_files(spark, sf_dir)).select("file_path", text.token_estimate(F.col("content")).alias("tokens"))


@query(f"{_V} SELECT rule_id, count(*) AS n, count(DISTINCT file_path) AS n_files FROM v GROUP BY 1")
def pattern_scan_hits(spark, sf_dir):
    return _violations(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("n_files"))


@query(f"{_V} SELECT rule_id, file_path, line_start, col_start, col_end, severity, message, confidence, in_test_file FROM v")
def pattern_scan_spans(spark, sf_dir):
    return _violations(spark, sf_dir).select("rule_id", "file_path", "line_start", "col_start", "col_end", "severity", "message", "confidence", "in_test_file")


@query(f"{_V} SELECT rule_id, file_path, line_start, snippet FROM v")
def snippet_redacted(spark, sf_dir):
    return _violations(spark, sf_dir).select("rule_id", "file_path", "line_start", "snippet")


def _redact_sql(column: str) -> str:
    for p in text.SECRETS:
        column = f"regexp_replace({column}, {_quoted(p)}, '[REDACTED]', 'g')"
    return column


@query(f"{_LINES} SELECT doc_id, line_no, {_redact_sql('line')} AS redacted FROM lines")
def redact_secrets(spark, sf_dir):
    return _marked_lines(spark, sf_dir).select("doc_id", "line_no", text.redact_secrets(F.col("line")).alias("redacted"))


@query(f"{_LINES} SELECT count(*) FILTER (WHERE regexp_matches(line, '[0-9]{{16}}')) AS hits, count(*) FILTER (WHERE regexp_matches(line, '[0-9]{{16}}') AND regexp_matches(line, '[0-9a-f]{{32}}', 'i')) AS excluded FROM lines")
def exclude_patterns(spark, sf_dir):
    line, rule = F.col("line"), _exposure().rules[0]
    hit, out = line.rlike(rules.java_regex(rule.patterns[0])), line.rlike(rules.java_regex(rule.exclude_patterns[0]))
    return _marked_lines(spark, sf_dir).agg(F.count_if(hit).alias("hits"), F.count_if(hit & out).alias("excluded"))


def _suppressed_sql(head: str, ids: list[str]) -> str:
    named = f"regexp_extract(line, '{head}', 1, 'i')"
    hit = " OR ".join(f"list_contains(list_transform(string_split({named}, ','), lambda x: trim(x)), '{i}')" for i in ids)
    return f"{_LINES} SELECT doc_id, line_no FROM lines WHERE regexp_matches(line, '{head}', 'i') AND ({named} = '' OR {hit})"


@query(_suppressed_sql(r"(?:#|//)\s*noqa(?::\s*([\w/,.\-\s]+))?", ["corpus/exposure/email"]))
def noqa_suppress(spark, sf_dir):
    return _marked_lines(spark, sf_dir).filter(scan.noqa_suppresses(F.col("line"), "corpus/exposure/email")).select("doc_id", "line_no")


@query(_suppressed_sql(r"(?:#|//)\s*scan:disable(?:=\s*([\w/,.\-\s]+))?", ["corpus/exposure/card-number", "card-number"]))
def inline_disable(spark, sf_dir):
    return _marked_lines(spark, sf_dir).filter(scan.directive_suppresses(F.col("line"), "corpus/exposure/card-number")).select("doc_id", "line_no")


@query(f"{_V} SELECT severity, in_test_file, count(*) AS n FROM v GROUP BY 1, 2")
def severity_cap(spark, sf_dir):
    return _violations(spark, sf_dir).groupBy("severity", "in_test_file").agg(F.count(F.lit(1)).alias("n"))


_SEV = "(VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(SEVERITIES)) + ") s(severity, rank)"


@query(f"{_V} SELECT s.severity, s.rank, coalesce(n, 0) AS n FROM {_SEV} LEFT JOIN (SELECT severity, count(*) AS n FROM v GROUP BY 1) USING (severity)")
def by_severity(spark, sf_dir):
    return scan.by_severity(_violations(spark, sf_dir))


@query(f"{_V} SELECT regexp_replace(rule_id, '/[^/]*$', '') AS pack_id, count(*) AS n FROM v GROUP BY 1")
def by_pack(spark, sf_dir):
    return scan.by_pack(_violations(spark, sf_dir))


@query(f"{_V} SELECT CASE WHEN min({_RANK}) <= 0 THEN 'failed' WHEN min({_RANK}) <= 1 THEN 'warned' ELSE 'passed' END AS status, count(*) AS total_violations FROM v")
def gate_status(spark, sf_dir):
    return scan.gate(_violations(spark, sf_dir))


_HTML = r"""WITH files AS (SELECT 'pages/' || page_id || '.conf' AS file_path, html AS content FROM pages),
l AS (SELECT file_path, unnest(regexp_split_to_array(coalesce(content, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS line FROM files)
SELECT file_path, count(*) FILTER (WHERE regexp_matches(line, '[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}', 'i')) AS emails, count(*) FILTER (WHERE regexp_matches(line, 'licen[cs]e|copyright', 'i')) AS licences FROM l GROUP BY 1"""


@query(_HTML)
def pages_scan(spark, sf_dir):
    lines = text.explode_lines(src.pages_as_files(table(spark, sf_dir, "pages")))
    return lines.groupBy("file_path").agg(F.count_if(F.col("line").rlike(r"(?iU)[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}")).alias("emails"), F.count_if(F.col("line").rlike(r"(?iU)licen[cs]e|copyright")).alias("licences"))


@query("SELECT 'conversations/' || conv_id || '.md' AS file_path, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS content FROM conversations GROUP BY conv_id")
def conversation_files(spark, sf_dir):
    return src.conversations_as_files(table(spark, sf_dir, "conversations"))


# --- baselines and renderings -------------------------------------------------------------------------------------------

@query(f"{_V} SELECT rule_id, file_path, line_start, {_FINGER} AS fingerprint FROM v")
def fingerprint(spark, sf_dir):
    return _violations(spark, sf_dir).select("rule_id", "file_path", "line_start", text.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet")).alias("fingerprint"))


_ANTI = f"{_V}, k AS (SELECT *, {_FINGER} AS fingerprint FROM v), n AS (SELECT * FROM k WHERE fingerprint NOT IN (SELECT fingerprint FROM k WHERE line_start % 2 = 1))"


def _new(spark, sf_dir):
    v = _violations(spark, sf_dir)
    return scan.without_known(v, scan.baseline_of(v.filter(F.col("line_start") % 2 == 1)))


@query(f"{_ANTI} SELECT rule_id, file_path, line_start, fingerprint FROM n")
def baseline_anti_join(spark, sf_dir):
    return _new(spark, sf_dir).select("rule_id", "file_path", "line_start", "fingerprint")


@query(f"{_ANTI} SELECT rule_id, count(*) AS n FROM n GROUP BY 1")
def baseline_new_by_rule(spark, sf_dir):
    return _new(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_V} SELECT rule_id, CAST(row_number() OVER (ORDER BY f, s, l) - 1 AS INTEGER) AS rule_index FROM (SELECT rule_id, arg_min(file_path, (file_path, rule_seq, line_start)) AS f, arg_min(rule_seq, (file_path, rule_seq, line_start)) AS s, arg_min(line_start, (file_path, rule_seq, line_start)) AS l FROM v GROUP BY 1)")
def sarif_rule_index(spark, sf_dir):
    return reports.rule_index(_violations(spark, sf_dir))


@query(f"{_V} SELECT place, CAST(place // 50 AS INTEGER) AS batch, file_path AS path, line_start AS start_line, {_case('severity', {_quoted(k): v for k, v in reports.ANNOTATION_LEVEL.items()})} AS annotation_level, '[' || severity || '] ' || rule_name AS title FROM (SELECT *, row_number() OVER (ORDER BY file_path, rule_seq, line_start) - 1 AS place FROM v)")
def annotation_batches(spark, sf_dir):
    return reports.annotations(_violations(spark, sf_dir)).select("place", "batch", "path", "start_line", "annotation_level", "title")


@query(f"{_V} SELECT file_path, line_start, severity, rule_id, message, fix_hint FROM v WHERE confidence >= 0.5 ORDER BY {_RANK}, file_path, line_start, rule_id LIMIT 40")
def review_top40(spark, sf_dir):
    return reports.review_comments(_violations(spark, sf_dir))


@query(f"""{_V}, s AS (SELECT *, CASE WHEN confidence < 0.5 THEN 'low' WHEN in_test_file THEN 'test' ELSE 'production' END AS section FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY CASE section WHEN 'production' THEN {_RANK} ELSE 0 END, file_path, rule_seq, line_start) AS place FROM s),
k AS (SELECT * FROM r WHERE place <= CASE section WHEN 'production' THEN 30 WHEN 'test' THEN 20 ELSE 15 END)
SELECT section, CAST(place AS INTEGER) AS place, severity, section = 'production' AND severity IN ('CRITICAL', 'HIGH') AND row_number() OVER (PARTITION BY section, severity ORDER BY place) <= 10 AS detailed, rule_id, file_path, line_start FROM k""")
def comment_budget(spark, sf_dir):
    return reports.comment_rows(_violations(spark, sf_dir)).select("section", "place", "severity", "detailed", "rule_id", "file_path", "line_start")


@query(f"{_V} SELECT '::' || CASE WHEN {_RANK} <= 0 THEN 'error' ELSE 'warning' END || ' file=' || file_path || ',line=' || line_start || '::[' || rule_id || '] ' || left(message, 200) AS ci FROM v")
def ci_annotations(spark, sf_dir):
    return reports.ci_lines(_violations(spark, sf_dir)).select("ci")


@query(f"{_V} SELECT severity, {_case('severity', {_quoted(k): v for k, v in reports.SARIF_LEVEL.items()})} AS level, count(*) AS n FROM v GROUP BY 1, 2")
def sarif_levels(spark, sf_dir):
    v = _violations(spark, sf_dir)
    return v.groupBy("severity", reports.lookup(reports.SARIF_LEVEL, F.col("severity")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


# --- recorded model answers ---------------------------------------------------------------------------------------------

def _values(rows, cols: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else _quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + f") AS t({cols})"


def _candidates(spark, sf_dir) -> DataFrame:
    """A finding of one of four rules for every line of the corpus."""
    lines = text.explode_lines(_files(spark, sf_dir), "content", "file_path")
    return lines.select("file_path", F.concat(F.lit("p/r"), (F.col("line_no") % 4).cast("string")).alias("rule_id"), F.col("line_no").alias("line_start"), "line_no")


_ALL_LINES = f"{_LINES}, c AS (SELECT file_path, 'p/r' || (line_no % 4) AS rule_id, CAST(line_no AS INTEGER) AS line_start, line_no FROM plain)"


@query(f"""{_ALL_LINES}, r AS (
 SELECT file_path, rule_id, line_start, CASE line_no % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' ELSE 'KEEP' END AS verdict, CASE WHEN line_no % 2 = 0 THEN CAST(0.65 AS DOUBLE) END AS adjusted, 0 AS seq FROM c
 UNION ALL SELECT file_path, rule_id, line_start, 'keep', CAST(0.9 AS DOUBLE), 1 FROM c WHERE line_no % 5 = 0)
SELECT c.file_path, c.rule_id, c.line_start, k.confidence FROM c JOIN (SELECT file_path, rule_id, line_start, arg_max(coalesce(adjusted, CAST(0.7 AS DOUBLE)), seq) AS confidence FROM r WHERE lower(verdict) = 'keep' GROUP BY 1, 2, 3) k USING (file_path, rule_id, line_start)""")
def critic_semi_join(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    verdict = F.when(F.col("line_no") % 3 == 0, "keep").when(F.col("line_no") % 3 == 1, "reject").otherwise("KEEP")
    first = c.select("file_path", "rule_id", "line_start", verdict.alias("verdict"), F.when(F.col("line_no") % 2 == 0, F.lit(0.65)).alias("adjusted_confidence"), F.lit(0).alias("seq"))
    second = c.filter(F.col("line_no") % 5 == 0).select("file_path", "rule_id", "line_start", F.lit("keep").alias("verdict"), F.lit(0.9).alias("adjusted_confidence"), F.lit(1).alias("seq"))
    return judged.critic_keeps(c, first.unionByName(second)).select("file_path", "rule_id", "line_start", "confidence")


@query(f"""{_ALL_LINES}, n AS (SELECT file_path, max(line_no) AS n FROM plain GROUP BY 1),
k AS (SELECT file_path, rule_id, 2 * line_no - 3 AS a, line_no + 5 AS b, CASE line_no % 3 WHEN 0 THEN CAST(0.9 AS DOUBLE) WHEN 1 THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS conf FROM c WHERE rule_id <> 'p/r3'),
j AS (SELECT file_path, rule_id, greatest(1, least(a, n)) AS s, b, n, CASE WHEN {_TEST} THEN least(conf, CAST(0.3 AS DOUBLE)) WHEN {_MIGRATION} THEN least(conf, CAST(0.4 AS DOUBLE)) ELSE conf END AS confidence FROM k JOIN n USING (file_path) WHERE {_TEST} OR {_MIGRATION} OR conf >= 0.6)
SELECT file_path, rule_id, CAST(s AS INTEGER) AS line_start, CAST(greatest(s, least(b, n)) AS INTEGER) AS line_end, confidence FROM j""")
def judged_findings(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    score = F.when(F.col("line_no") % 3 == 0, F.lit(0.9)).when(F.col("line_no") % 3 == 1, F.lit(0.65)).otherwise(F.lit(0.5))
    kept = c.select("file_path", "rule_id", (2 * F.col("line_no") - 3).alias("line_start"), (F.col("line_no") + 5).alias("line_end"), score.alias("confidence"))
    known = spark.createDataFrame([(f"p/r{i}", "one", "HIGH", None) for i in range(3)], "rule_id string, name string, severity string, fix_hint string")
    counts = c.groupBy("file_path").agg(F.max("line_no").alias("n_lines"))
    return judged.findings(kept, known, counts).select("file_path", "rule_id", "line_start", "line_end", "confidence")


@query(f"""{_V}, n AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rule_seq, line_start) - 1 AS idx FROM v)
SELECT rule_id, file_path, line_start, CASE WHEN idx = 0 THEN greatest(CAST(0.1 AS DOUBLE), confidence - CAST(0.5 AS DOUBLE)) ELSE confidence END AS confidence, CASE WHEN idx = 0 THEN message || ' (sample data)' ELSE message END AS message FROM n""")
def enhancer_apply(spark, sf_dir):
    v = _violations(spark, sf_dir)
    answers = v.select("file_path").distinct().select("file_path", F.lit(0).alias("idx"), F.lit(True).alias("false_positive"), F.lit("sample data").alias("reason"), F.lit(None).cast("string").alias("better_hint"), F.lit(None).cast("string").alias("reference"))
    return judged.enhance(v, answers).select("rule_id", "file_path", "line_start", "confidence", "message")


# --- structure and privacy ----------------------------------------------------------------------------------------------

#: What some documents of the made-up tree say besides, so that the searches find something.
_SAYS = {1: "retention_policy = 30", 2: "DB_HOST = x.rds.amazonaws.com", 3: "AWS_REGION = ap-south-1", 4: "if age >= 18:", 5: "parental_consent = True", 6: "beat_schedule = 1", 7: "incident_response()", 8: "class Command(BaseCommand): send_mail()", 9: "WEBHOOK_URL = 1"}


def _sql_pick(values) -> str:
    return f"CASE turn % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _map_sql(column: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {otherwise} END"


_TREE = f"""WITH base AS (SELECT doc_id AS d, doc_id // 6 AS turn, doc_id % 6 AS k, coalesce(n_chars, 0) AS n, 'M' || doc_id AS model FROM documents),
py AS (SELECT *, 'app/m' || d || '.py' AS file, {_sql_pick(src.CODE_LIBRARIES)} AS lib, {_sql_pick(src.CODE_FIELDS)} AS ftype, {_sql_pick(src.CODE_ACTIONS)} AS act, turn % 2 = 0 AS nul FROM base WHERE k = 0),
rb AS (SELECT *, 'app/m' || d || '.rb' AS file, {_sql_pick(src.CODE_DEPENDENTS)} AS dep FROM base WHERE k = 1),
js AS (SELECT *, 'app/m' || d || '.js' AS file, {_sql_pick(src.CODE_COLUMNS)} AS ftype, CASE WHEN turn % 2 = 0 THEN 'bcrypt' ELSE 'cors' END AS lib FROM base WHERE k = 2),
java AS (SELECT *, 'app/M' || d || '.java' AS file, {_sql_pick(src.CODE_JAVA)} AS ftype FROM base WHERE k = 3),
prisma AS (SELECT *, 'm' || d || '.prisma' AS file, {_sql_pick(src.CODE_PRISMA)} AS ftype FROM base WHERE k = 4),
fields AS (
 SELECT model, 'name' AS name, ftype AS field_type, {_map_sql("ftype", {k: v for k, v in structure.fixed.FIELD_TYPES["django"].items() if k in src.CODE_FIELDS}, "NULL")} || CASE WHEN nul THEN ' | None' ELSE '' END AS python_type, nul AS is_nullable, ftype = 'EncryptedCharField' AS is_encrypted, CAST(n % 200 + 1 AS INTEGER) AS max_length, NULL AS related_model, NULL AS on_delete, file, 6 AS line FROM py
 UNION ALL SELECT model, 'owner', 'ForeignKey', 'int', FALSE, FALSE, NULL, 'M' || (d + 6), act, file, 7 FROM py
 UNION ALL SELECT model, 'email', ftype, {_map_sql("ftype", structure.fixed.FIELD_TYPES["sequelize"], "ftype")}, FALSE, FALSE, NULL, NULL, NULL, file, 4 FROM js
 UNION ALL SELECT model, 'code', ftype, {_map_sql("ftype", structure.fixed.FIELD_TYPES["java"], "ftype")}, FALSE, FALSE, NULL, NULL, NULL, file, 4 FROM java
 UNION ALL SELECT model, 'id', 'Int', 'int', FALSE, FALSE, NULL, NULL, NULL, file, 2 FROM prisma
 UNION ALL SELECT model, 'note', ftype || '?', {_map_sql("ftype", structure.fixed.FIELD_TYPES["prisma"], "ftype")}, TRUE, FALSE, NULL, NULL, NULL, file, 3 FROM prisma),
paths AS (
 SELECT model AS source_model, 'owner' AS field_name, 'M' || (d + 6) AS target_model, act AS on_delete, act = 'PROTECT' AS is_blocker, file, 7 AS line FROM py
 UNION ALL SELECT model, 'm' || d || '_items', 'M' || d || '_Item', {_map_sql("dep", structure.fixed.DEPENDENT, "'UNKNOWN'")}, dep LIKE 'restrict%', file, 2 FROM rb),
libs AS (
 SELECT lib AS module, file, 1 AS line, CASE lib WHEN 'cryptography.fernet' THEN 'encryption' WHEN 'hashlib' THEN 'hashing' WHEN 'jwt.api' THEN 'auth' WHEN 'sentry_sdk' THEN 'logging' ELSE 'auth' END AS category FROM py WHERE lib IN ('cryptography.fernet', 'hashlib', 'jwt.api', 'sentry_sdk', 'Django.contrib.auth')
 UNION ALL SELECT lib, file, 1, CASE lib WHEN 'bcrypt' THEN 'hashing' ELSE 'security' END FROM js
 UNION ALL SELECT 'slf4j', file, 1, 'logging' FROM java),
models AS (SELECT model AS name, file, 5 AS line, TRUE AS has_delete FROM py UNION ALL SELECT model, file, 1, FALSE FROM rb UNION ALL SELECT model, file, 3, FALSE FROM js UNION ALL SELECT model, file, 2, FALSE FROM java UNION ALL SELECT model, file, 1, FALSE FROM prisma),
said AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'PII' WHEN 1 THEN 'SENSITIVE_PII' ELSE 'NOT_PII' END AS class FROM py WHERE turn % 7 <> 3),
pii AS (SELECT model, 'name' AS field, class AS classification FROM said UNION ALL SELECT model, 'owner', 'INDIRECT' FROM said UNION ALL SELECT 'X' || d, 'gone', 'PII' FROM said WHERE turn % 5 = 0),
personal AS (SELECT DISTINCT model FROM pii WHERE classification IN ('PII', 'SENSITIVE_PII')),
tree AS (SELECT {_PATH} AS file_path, text || {"CASE doc_id % 61 " + " ".join(f"WHEN {k} THEN chr(10) || '{v}'" for k, v in _SAYS.items()) + " ELSE '' END"} AS content FROM documents),
tpy AS (SELECT * FROM tree WHERE file_path LIKE '%.py')"""


def _tree(spark, sf_dir) -> DataFrame:
    return src.documents_as_code(table(spark, sf_dir, "documents")).select("file_path", "content")


def _answers(spark, sf_dir) -> DataFrame:
    """A recorded classification for every Python model of the tree; some are no JSON, some name a model that is not there."""
    d, turn = F.col("doc_id").cast("string"), F.floor(F.col("doc_id") / 6)
    said = F.element_at(F.array(*map(F.lit, ("pii", "Sensitive PII", "not_pii", "weird"))), (turn % 4).cast("int") + 1)
    field = lambda name, c: F.struct(F.lit(name).alias("field_name"), c.alias("classification"), F.lit("r").alias("reason"))
    model = lambda name, *fields: F.struct(name.alias("model_name"), F.array(*fields).alias("fields"))
    own = model(F.concat(F.lit("M"), d), field("name", said), field("owner", F.lit("indirect")))
    gone = model(F.concat(F.lit("X"), d), field("gone", F.lit("PII")))
    models = F.when(turn % 5 == 0, F.array(own, gone)).otherwise(F.array(own))
    special = F.when(turn % 3 == 0, F.array(F.concat(F.lit("M"), d, F.lit(".name")))).otherwise(F.array().cast("array<string>"))
    answer = F.to_json(F.struct(models.alias("models"), special.alias("aadhaar_fields"), (turn % 11 == 0).alias("children_data_risk")))
    rows = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 6 == 0)
    return rows.select(F.when(turn % 7 == 3, "sorry, I cannot").otherwise(answer).alias("answer"))


def _code(spark, sf_dir) -> dict[str, DataFrame]:
    code = structure.code_tables(_tree(spark, sf_dir))
    extra = None
    for k, v in _SAYS.items():
        extra = F.when(F.col("doc_id") % 61 == k, f"\n{v}") if extra is None else extra.when(F.col("doc_id") % 61 == k, f"\n{v}")
    return code | {"files": _files(spark, sf_dir).withColumn("content", F.concat("content", extra.otherwise("")))}


def _pii(spark, sf_dir, code) -> DataFrame:
    return privacy.classified(_answers(spark, sf_dir), code["models"], code["fields"]).select("model", "field", "classification", "reason")


def _in(values) -> str:
    return "(" + ", ".join(map(_quoted, values)) + ")"


@query(f"""{_TREE}
SELECT file, 'import' AS kind, NULL AS owner, lib AS name, 1 AS line, NULL AS value, NULL AS extra FROM py
UNION ALL SELECT file, 'import', NULL, 'django.db', 2, NULL, NULL FROM py
UNION ALL SELECT file, 'class', NULL, model, 5, 'models.Model', 'delete' FROM py
UNION ALL SELECT file, 'field', model, 'name', 6, ftype, 'max_length=' || (n % 200 + 1) || '|null=' || CASE WHEN nul THEN 'True' ELSE 'False' END FROM py
UNION ALL SELECT file, 'field', model, 'owner', 7, 'ForeignKey', chr(39) || 'M' || (d + 6) || chr(39) || '|on_delete=models.' || act FROM py
UNION ALL SELECT file, 'function', NULL, 'delete', 9, '    def delete(self):' || chr(10) || '        return None', '8' FROM py
UNION ALL SELECT file, 'model', NULL, model, 1, NULL, NULL FROM rb
UNION ALL SELECT file, 'field', model, 'm' || d || '_items', 2, 'has_many', ', dependent: :' || dep FROM rb
UNION ALL SELECT file, 'model', NULL, model, 3, NULL, NULL FROM js
UNION ALL SELECT file, 'field', model, 'email', 4, ftype, NULL FROM js
UNION ALL SELECT file, 'route', NULL, '/m' || d || '/', 2, 'GET', 'list' || d FROM js
UNION ALL SELECT file, 'model', NULL, model, 2, NULL, NULL FROM java
UNION ALL SELECT file, 'field', model, 'code', 4, ftype, NULL FROM java
UNION ALL SELECT file, 'model', NULL, model, 1, NULL, NULL FROM prisma
UNION ALL SELECT file, 'field', model, 'id', 2, 'Int', NULL FROM prisma
UNION ALL SELECT file, 'field', model, 'note', 3, ftype || '?', NULL FROM prisma""")
def structure_extract(spark, sf_dir):
    return structure.extract(_tree(spark, sf_dir))


@query(f"{_TREE} SELECT name, file, CAST(line AS INTEGER) AS line, has_delete AS has_delete_method FROM models")
def models_of_code(spark, sf_dir):
    return structure.models(structure.extract(_tree(spark, sf_dir))).select("name", "file", "line", "has_delete_method")


@query(f"{_TREE} SELECT model, name, field_type, python_type, is_nullable, is_encrypted, max_length, related_model, on_delete, file, CAST(line AS INTEGER) AS line FROM fields")
def field_types(spark, sf_dir):
    return structure.fields(structure.extract(_tree(spark, sf_dir)))


@query(f"{_TREE} SELECT source_model, field_name, target_model, on_delete, is_blocker, file, CAST(line AS INTEGER) AS line FROM paths")
def cascade_parse(spark, sf_dir):
    return structure.delete_paths(structure.extract(_tree(spark, sf_dir)))


@query(f"{_TREE} SELECT module, file, CAST(line AS INTEGER) AS line, category FROM libs")
def library_category(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return structure.libraries(structure.extract(tree), tree).select("module", "file", "line", "category")


@query("SELECT 'svc' || doc_id || '/requirements.txt' AS file_path, p.package, CASE p.package WHEN 'flask' THEN '2.' || (doc_id % 10) ELSE '1.' || (doc_id % 7) || '.0' END AS version FROM documents, (VALUES ('flask'), ('requests')) p(package) WHERE doc_id % 6 = 5")
def dependency_versions(spark, sf_dir):
    return structure.dependencies(_tree(spark, sf_dir))


@query("""WITH d AS (SELECT 'requirements.txt' AS f, min(doc_id) AS k FROM documents) SELECT 'django' AS "primary", '4.' || k AS version, 'django-orm' AS orm, TRUE AS has_drf, TRUE AS has_celery, TRUE AS has_jwt, FALSE AS has_oauth, 'JWTAuthentication' AS auth, 'app/settings_' || k || '.py' AS settings, TRUE AS global_auth_required FROM d""")
def framework_details(spark, sf_dir):
    """A manifest and a settings file beside the tree, both named after the least document."""
    k = table(spark, sf_dir, "documents").agg(F.min("doc_id").cast("string").alias("k"))
    manifest = k.select(F.lit("requirements.txt").alias("file_path"), F.concat(F.lit("Django>=4."), "k", F.lit("\ndjangorestframework==3\ncelery=5\npyjwt > 2\n")).alias("content"))
    settings = k.select(F.concat(F.lit("app/settings_"), "k", F.lit(".py")).alias("file_path"), F.lit("DEFAULT_PERMISSION_CLASSES = [IsAuthenticated]\nx = JWTAuthentication").alias("content"))
    out = structure.framework(_tree(spark, sf_dir).unionByName(manifest).unionByName(settings))
    return out.select("primary", "version", "orm", "has_drf", "has_celery", "has_jwt", "has_oauth", F.array_join("auth_middleware", ",").alias("auth"), F.array_join("settings_files", ",").alias("settings"), "global_auth_required")


@query(f"""{_TREE}, m AS (SELECT *, row_number() OVER (ORDER BY file, line, name) - 1 AS place FROM (SELECT * FROM models WHERE name IN (SELECT model FROM fields)))
SELECT CAST(place // 25 + 1 AS INTEGER) AS batch, place, name AS model FROM m""")
def model_batches(spark, sf_dir):
    rows = structure.extract(_tree(spark, sf_dir))
    return privacy.model_batches(structure.models(rows), structure.fields(rows)).select("batch", "place", "model")


@query(f"""{_TREE} SELECT p.model, p.field, p.classification, coalesce(m.file, '') AS file, coalesce(f.field_type, '') AS field_type
FROM pii p LEFT JOIN models m ON m.name = p.model LEFT JOIN fields f ON f.model = p.model AND f.name = p.field""")
def pii_classified(spark, sf_dir):
    rows = structure.extract(_tree(spark, sf_dir))
    return privacy.classified(_answers(spark, sf_dir), structure.models(rows), structure.fields(rows)).select("model", "field", "classification", "file", "field_type")


@query(f"{_TREE} SELECT 'aadhaar' AS kind, model || '.name' AS field FROM said WHERE turn % 3 = 0 AND ftype <> 'EncryptedCharField'")
def special_unencrypted(spark, sf_dir):
    fields = structure.fields(structure.extract(_tree(spark, sf_dir)))
    return privacy.special_unencrypted(privacy.special_fields(_answers(spark, sf_dir)), fields)


@query("SELECT doc_id, substr(sha256(source || ':' || coalesce(lang, 'unknown')), 1, 16) AS key FROM documents")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", privacy.cache_key(F.col("source"), F.col("lang")).alias("key"))


@query(f"{_TREE} SELECT count(*) AS total, count(*) FILTER (classification = 'PII') AS pii, count(*) FILTER (classification = 'SENSITIVE_PII') AS sensitive, count(*) FILTER (classification = 'INDIRECT') AS indirect, count(*) FILTER (classification = 'NOT_PII') AS not_pii, (SELECT count(*) FROM personal) AS pii_models FROM pii")
def pii_stats(spark, sf_dir):
    return privacy.pii_stats(_pii(spark, sf_dir, _code(spark, sf_dir)))


@query(f"{_TREE} SELECT (SELECT count(*) FROM models) AS models, (SELECT count(*) FROM models WHERE has_delete) AS with_delete, CAST(0 AS BIGINT) AS with_soft_delete, (SELECT count(*) FROM fields) AS fields, (SELECT count(*) FROM fields WHERE is_encrypted) AS encrypted_fields, (SELECT count(*) FROM js) AS endpoints, CAST(0 AS BIGINT) AS with_auth, (SELECT count(*) FROM libs) AS libraries")
def codebase_stats(spark, sf_dir):
    c = _code(spark, sf_dir)
    return privacy.codebase_stats(c["models"], c["fields"], c["endpoints"], c["libraries"])


def _shown(df: DataFrame) -> DataFrame:
    return df.select("section", "status", F.array_join("evidence", "|").alias("evidence"), F.array_join("blockers", "|").alias("blockers"))


def _section(f, spark, sf_dir) -> DataFrame:
    code = _code(spark, sf_dir)
    return _shown(f(code, _pii(spark, sf_dir, code)))


def _least(what: str, rows: str, n: int) -> str:
    return f"(SELECT coalesce(string_agg(v, '|' ORDER BY v), '') FROM (SELECT DISTINCT {what} AS v FROM {rows} ORDER BY 1 LIMIT {n}))"


def _both(*lists: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(lists) + "], lambda x: x <> ''), '|')"


def _hits(patterns) -> str:
    """The first pattern's leftmost match as "line: match"."""
    out = ""
    for p in patterns:
        m = f"regexp_extract(content, '{p}', 0, 'i')"
        before = f"left(content, strpos(content, {m}) - 1)"
        out += f" WHEN regexp_matches(content, '{p}', 'i') THEN (length({before}) - length(replace({before}, chr(10), '')) + 1) || ': ' || {m}"
    return f"CASE{out} END"


@query(f"""{_TREE}, j AS (SELECT p.model || '.' || p.field AS f, coalesce(f.is_encrypted, FALSE) AS e FROM pii p LEFT JOIN fields f ON f.model = p.model AND f.name = p.field WHERE p.classification IN ('PII', 'SENSITIVE_PII'))
SELECT '§8(4)' AS section, CASE WHEN count(*) FILTER (NOT e) = 0 THEN 'COMPLIANT' WHEN count(*) FILTER (e) = 0 THEN 'NON_COMPLIANT' ELSE 'PARTIAL' END AS status, {_least("'encrypted: ' || f", "j WHERE e", 10)} AS evidence, {_least("'not encrypted: ' || f", "j WHERE NOT e", 10)} AS blockers FROM j""")
def encryption_status(spark, sf_dir):
    return _section(privacy.encryption, spark, sf_dir)


@query(f"""{_TREE} SELECT file_path, {_hits(privacy.RETENTION_POLICY)} AS policy, {_hits(privacy.SCHEDULERS)} AS scheduler
FROM tpy WHERE {_any('content', privacy.RETENTION_POLICY + privacy.SCHEDULERS)}""")
def retention_evidence(spark, sf_dir):
    return privacy.evidence(_code(spark, sf_dir)["files"], {"policy": privacy.RETENTION_POLICY, "scheduler": privacy.SCHEDULERS})


@query(f"""{_TREE}, f AS (SELECT * FROM tree WHERE regexp_matches(file_path, '([.]py|[.]ya?ml|[.]toml|[.]ini|[.]env|[.]conf)$', 'i')),
l AS (SELECT unnest(string_split(content, chr(10))) AS line FROM f),
r AS (SELECT count(*) FILTER ({_any('line', ['|'.join(privacy.INDIAN_REGIONS)])}) AS home, count(*) FILTER ({_any('line', [privacy.FOREIGN_REGIONS])}) AS abroad FROM l WHERE {_any('line', privacy.REGIONS)}),
n AS (SELECT count(*) FILTER ({_any('content', privacy.REGIONS + privacy.STORAGE + privacy.DATABASES)}) AS said FROM f)
SELECT '§11' AS section, CASE WHEN said = 0 THEN 'UNKNOWN' WHEN home > 0 AND abroad = 0 THEN 'COMPLIANT' ELSE 'PARTIAL' END AS status,
 {_both(_least("'region: ' || file_path", "f WHERE " + _any("content", privacy.REGIONS), 15), _least("'calls another service: ' || file_path", "tpy WHERE " + _any("content", [p.replace("(?:", "(") for p in privacy.EXTERNAL_CALLS]), 5))} AS evidence,
 CASE WHEN abroad > 0 THEN 'A region abroad is configured.' ELSE '' END AS blockers FROM r, n""")
def localisation_status(spark, sf_dir):
    return _section(privacy.localisation, spark, sf_dir)


@query("SELECT customer.c_custkey AS name, coalesce(nullif(list(o.o_orderstatus ORDER BY o.o_orderstatus) FILTER (o.o_orderstatus IS NOT NULL), []), ['none']) AS fields FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) o ON o.o_custkey = customer.c_custkey GROUP BY 1")
def model_merge(spark, sf_dir):
    have = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("fields"))
    other = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.array(F.lit("none")).alias("fields"))
    return structure.merge_models(have, other)


@query("SELECT o_custkey AS name, arg_min(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS line FROM orders GROUP BY 1")
def model_dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.lit("orders").alias("file"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("status"))
    return structure._first(rows, "name").select("name", "status", "line")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, '/api/' || lower(replace(n_name, ' ', '_')) AS path FROM nation")
def routes_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("k"), structure.join_route(F.lit("/api/"), F.concat(F.lit("/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("/"))).alias("path"))


@query("SELECT DISTINCT p_type AS name, list_aggregate(list_transform(string_split(regexp_replace(replace(lower(p_type), ' ', '_'), 's+$', ''), '_'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), 'string_agg', '') AS model FROM part")
def table_to_model(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_type").distinct()
    return p.select(F.col("p_type").alias("name"), text.model_from_table(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))).alias("model"))


@query("SELECT DISTINCT o_orderpriority AS said, CASE WHEN replace(upper(trim(o_orderpriority)), ' ', '_') IN ('PII', 'SENSITIVE_PII', 'INDIRECT', 'NOT_PII') THEN replace(upper(trim(o_orderpriority)), ' ', '_') ELSE 'NOT_PII' END AS class FROM orders")
def classification_normalise(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("said")).distinct().select("said", privacy.normalise_classification(F.col("said")).alias("class"))


# --- events -------------------------------------------------------------------------------------------------------------

def _event_json(e: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "click", "opened").when(F.col("event_type") == "view", "synchronize").when(F.col("event_type") == "signup", "labeled").otherwise("reopened")
    body = F.struct(action.alias("action"), F.struct((F.col("user_id") % 50).cast("int").alias("number"), F.when(F.col("event_id") % 7 == 0, "closed").otherwise("open").alias("state"), (F.col("event_id") % 5 == 0).alias("draft"), F.struct(F.col("user_id").cast("string").alias("sha")).alias("head")).alias("pull_request"), F.struct(F.lit("o/r").alias("full_name")).alias("repository"), F.struct(F.lit(1).alias("id")).alias("installation"))
    return e.select("event_id", "ts", F.to_json(body).alias("value"))


_WANTED = "event_type <> 'signup' AND event_id % 7 <> 0 AND event_id % 5 <> 0"


@query(f"SELECT event_id, coalesce({_WANTED}, FALSE) AS scan FROM events")
def webhook_should_scan(spark, sf_dir):
    return stream.parse(_event_json(table(spark, sf_dir, "events"))).select("event_id", stream.should_scan().alias("scan"))


@query(f"SELECT 'o/r' AS repo, CAST(user_id % 50 AS INTEGER) AS number, CAST(user_id AS VARCHAR) AS sha, min(ts) AS ts FROM events WHERE {_WANTED} GROUP BY 1, 2, 3")
def event_dedupe(spark, sf_dir):
    return stream.to_scan(_event_json(table(spark, sf_dir, "events")))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_rates(spark, sf_dir):
    return stream.rates(table(spark, sf_dir, "events"))


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def installations_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return reports.latest(e, "user_id", "ts")


@query("SELECT event_type AS kind, CASE event_type WHEN 'click' THEN 'scan' WHEN 'view' THEN 'pong' ELSE 'ignored' END AS leads_to, count(*) AS n FROM events GROUP BY 1, 2")
def event_routing(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "pull_request").when(F.col("event_type") == "view", "ping").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), stream.route(kind, F.lit("created")).alias("leads_to")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_FILES} SELECT file_path, content FROM ctx WHERE doc_id % 3 <> 0 AND language IS NOT NULL")
def changed_files(spark, sf_dir):
    f = _files(spark, sf_dir)
    status = F.when(F.col("doc_id") % 3 == 0, "removed").otherwise("modified")
    return src.changed_files(f.select(F.col("file_path").alias("filename"), status.alias("status"), F.base64(F.encode("content", "utf-8")).alias("content")))


@query(f"{_V} SELECT rule_id, file_path, line_start, {_RANK} AS rank FROM v")
def severity_ranks(spark, sf_dir):
    return _violations(spark, sf_dir).select("rule_id", "file_path", "line_start", severity_rank(F.col("severity")).alias("rank"))


def _sarif_sql(fixes: str) -> str:
    region = "{'startLine': line_start, 'endLine': line_start, 'startColumn': col_start, 'endColumn': col_end, 'snippet': {'text': snippet}}"
    place = "{'physicalLocation': {'artifactLocation': {'uri': replace(file_path, chr(92), '/'), 'uriBaseId': '%SRCROOT%'}, 'region': " + region + "}}"
    level = _case("severity", {_quoted(k): v for k, v in reports.SARIF_LEVEL.items()})
    return "CAST(to_json({'ruleId': rule_id, 'ruleIndex': rule_index, 'level': " + level + ", 'message': {'text': message}, 'locations': [" + place + "]" + fixes + "}) AS VARCHAR)"


@query(f"""{_V}, i AS (SELECT rule_id, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS rule_index FROM (SELECT rule_id, min((file_path, rule_seq, line_start)) AS first FROM v GROUP BY 1))
SELECT CASE WHEN fix_hint IS NULL THEN {_sarif_sql("")} ELSE {_sarif_sql(", 'fixes': [{'description': {'text': fix_hint}}]")} END AS result FROM v JOIN i USING (rule_id)""")
def sarif_results(spark, sf_dir):
    return reports.sarif_results(_violations(spark, sf_dir)).select("result")


def _more() -> None:
    """The queries of other modules, which use this one's helpers."""
    importlib.import_module("spanwarden.catalog_rules")
    importlib.import_module("spanwarden.catalog_services")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _more()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(SQL)
