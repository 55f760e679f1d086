"""Renderings of violations: SARIF, check-run annotations, review and comment rows, CI lines, baselines, tables."""

from __future__ import annotations

import base64
import gzip
import json
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import SEVERITIES, severity_rank
from ..scratch import stored

#: Severity to the levels of the receiving formats.
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
ANNOTATION_LEVEL = {"CRITICAL": "failure", "HIGH": "failure", "MEDIUM": "warning", "LOW": "warning", "INFO": "notice"}
CONCLUSION = {"passed": "success", "warned": "neutral", "failed": "failure"}
SEVERITY_MARK = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🔵", "INFO": "⚪"}
STATUS_MARK = {"passed": "✅", "warned": "⚠️", "failed": "❌"}
BATCH, REVIEW_TOP, COMMENT_TOP, DETAILS, SUMMARY_CHARS = 50, 40, 30, 10, 65_000


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)


def _order(v: DataFrame) -> list[str]:
    return ["seq"] if "seq" in v.columns else ["file_path", "line_start", "rule_id"]


def with_place(v: DataFrame, name: str) -> DataFrame:
    """A running number from 0 in the natural order, without one task for all rows.

    Rows are dealt by ranges of the order and stored with the number of their range, so that both readers see the same
    ranges however the shuffle was planned. Totals of ranges (one row a partition) are accumulated; a window runs
    inside one range.
    """
    order = _order(v)
    dealt = stored(v.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order)
    numbered = dealt.withColumn("__in", F.row_number().over(inside) - 1)
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = numbered.join(F.broadcast(counts), "__part", "left")
    return placed.withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__part", "__in", "__before")


def rule_index(v: DataFrame) -> DataFrame:
    """rule_id, rule_index: rules by their first appearance. As many rows as rules."""
    firsts = v.groupBy("rule_id").agg(F.min(F.struct(*_order(v))).alias("first"))
    return firsts.select("rule_id", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("rule_index"))


def sarif_results(v: DataFrame) -> DataFrame:
    """One JSON result a violation."""
    region = F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine"), F.col("col_start").alias("startColumn"), F.col("col_end").alias("endColumn"), F.when(F.col("snippet").isNotNull(), F.struct(F.col("snippet").alias("text"))).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    fixes = F.when(F.col("fix_hint").isNotNull(), F.array(F.struct(F.struct(F.col("fix_hint").alias("text")).alias("description"))))
    body = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), lookup(SARIF_LEVEL, F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), fixes.alias("fixes"))
    return v.join(F.broadcast(rule_index(v)), "rule_id").select(*_order(v), F.to_json(body).alias("result"))


def sarif_frame(v: DataFrame, tool: str, version: str, run_id: str) -> tuple[str, str]:
    """What stands before and after the results; it has a row a rule."""
    rules = v.join(F.broadcast(rule_index(v)), "rule_id").groupBy("rule_index", "rule_id").agg(F.first("rule_name").alias("name"), F.first("severity").alias("severity"), F.first("fix_hint").alias("hint"), F.first(F.get("references", F.lit(0))).alias("link")).orderBy("rule_index")
    described = [{"id": r["rule_id"], "name": r["name"], "shortDescription": {"text": r["name"]}, "defaultConfiguration": {"level": SARIF_LEVEL[r["severity"]]}} | ({"help": {"text": r["hint"]}} if r["hint"] else {}) | ({"helpUri": r["link"]} if r["link"] else {}) for r in rules.collect()]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": described}}, "automationDetails": {"id": run_id}}
    return '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [' + json.dumps(run)[:-1] + ', "results": [', "]}]}"


def sarif_document(v: DataFrame, tool: str, version: str, run_id: str) -> Iterator[str]:
    """The document in pieces, rules first and then a partition of results at a time."""
    before, after = sarif_frame(v, tool, version, run_id)
    yield before
    for i, r in enumerate(sarif_results(v).orderBy(*_order(v)).toLocalIterator()):
        yield (", " if i else "") + r["result"]
    yield after


def sarif_transport(document: str) -> str:
    return base64.b64encode(gzip.compress(document.encode(), mtime=0)).decode()


def annotations(v: DataFrame) -> DataFrame:
    return with_place(v, "place").select(
        "place", F.floor(F.col("place") / BATCH).cast("int").alias("batch"), F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")).alias("path"), F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"),
        lookup(ANNOTATION_LEVEL, F.col("severity")).alias("annotation_level"), F.concat(F.lit("["), "severity", F.lit("] "), "rule_name").alias("title"), "message",
        F.concat(F.lit("Fix: "), F.nullif("fix_hint", F.lit(""))).alias("raw_details"),
    )


def annotation_batches(v: DataFrame) -> DataFrame:
    a = annotations(v)
    return a.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(*a.columns))).alias("annotations"))


def summary_text(summary: dict, duration_ms: int = 0) -> str:
    """A scan in words and one list; what is over the receiver's limit is cut off, with a note."""
    found = {s.lower(): n for s, n in summary["by_severity"].items() if n}
    kinds = ", ".join(f"{n} {s}" for s, n in found.items()) or "none"
    out = [f"The scan {summary['overall_status']}. It read {summary['total_files_scanned']} files in {duration_ms / 1000:.1f} s and has {summary['total_violations']} findings: {kinds}."]
    out += [f"* `{pack}` has {n}" for pack, n in summary["by_pack"].items()]
    said = "\n".join(out)
    note = "\n(more than can be shown)"
    return said if len(said) <= SUMMARY_CHARS else said[: SUMMARY_CHARS - len(note)] + note


def check_run_start(head_sha: str, started_at: str, name: str = "scan") -> dict:
    return {"name": name, "head_sha": head_sha, "status": "in_progress", "started_at": started_at}


def check_run(v: DataFrame, summary: dict, completed_at: str, duration_ms: int = 0, name: str = "scan") -> dict:
    """What completes a check run: the first batch of annotations and the summary; ``annotation_batches`` has the others."""
    first = [{k: x for k, x in r.asDict().items() if x is not None} for r in annotations(v).filter(F.col("place") < BATCH).orderBy("place").drop("place", "batch").collect()]
    output = {"title": f"{name} {summary['overall_status']}, {summary['total_violations']} findings", "summary": summary_text(summary, duration_ms), "annotations": first}
    return {"status": "completed", "conclusion": CONCLUSION.get(summary["overall_status"], "neutral"), "completed_at": completed_at, "output": output}


def inline_comment(v: DataFrame) -> Column:
    """The body of a violation's comment in a review: what it is, what to do, where to read on."""
    where = F.when(F.col("in_test_file"), ", in a test").otherwise("")
    head = F.concat("rule_name", F.lit(" ("), F.lower("severity"), where, F.lit(", "), text.percent(F.col("confidence")), F.lit(" sure)\n"), "message")
    hint = F.when(F.coalesce("fix_hint", F.lit("")) != "", F.concat(F.lit("\n> "), "fix_hint")).otherwise("")
    more = F.when(F.size("references") > 0, F.concat(F.lit("\nRead on: "), F.array_join(F.slice("references", 1, 3), ", "))).otherwise("")
    return F.concat(head, hint, more, F.lit("\nTurn off with `"), "rule_id", F.lit("`"))


def review_comments(v: DataFrame, threshold: float = 0.5, top: int = REVIEW_TOP, body: bool = False) -> DataFrame:
    """The comments that a review shows: the most severe confident violations."""
    rank = severity_rank(F.col("severity"))
    return v.filter(F.col("confidence") >= threshold).orderBy(rank, "file_path", "line_start", *[c for c in ("rule_id",) if c in v.columns]).limit(top).select("file_path", "line_start", "severity", "rule_id", "message", "fix_hint", *([inline_comment(v).alias("body")] if body else []))


def review_payload(v: DataFrame, commit: str, threshold: float = 0.5, top: int = REVIEW_TOP) -> dict | None:
    rows = review_comments(v, threshold, top, body=True).collect()
    if not rows:
        return None
    sure = v.filter(F.col("confidence") >= threshold)
    counts = {r["severity"]: r["n"] for r in sure.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, tests = sum(counts.values()), sure.filter("in_test_file").count()
    said = [f"{total} findings: " + ", ".join(f"{counts[s]} {s.lower()}" for s in SEVERITIES if s in counts) + "."]
    said += [f"The {len(rows)} that weigh most have a comment below."] if total > len(rows) else []
    said += [f"Tests hold {tests} of them."] if tests else []
    event = "REQUEST_CHANGES" if any(r["severity"] in SEVERITIES[:2] for r in rows) else "COMMENT"
    return {"commit_id": commit, "event": event, "body": " ".join(said), "comments": [{"path": r["file_path"].replace("\\", "/"), "line": r["line_start"], "body": r["body"]} for r in rows]}


def comment_rows(v: DataFrame, budget: int = COMMENT_TOP) -> DataFrame:
    """Section, place and detail flag of what a comment shows. Low confidence is told apart first, then test files."""
    section = F.when(F.col("confidence") < 0.5, "low").when(F.col("in_test_file"), "test").otherwise("production")
    rank = severity_rank(F.col("severity"))
    limit = F.when(F.col("section") == "production", budget).when(F.col("section") == "test", 20).otherwise(15)
    # a section has three values, so only the first rows of each may meet: the limit is pushed below the shuffle
    w = Window.partitionBy("section").orderBy("rank", *_order(v))
    ranked = v.withColumn("section", section).withColumn("rank", F.when(F.col("section") == "production", rank).otherwise(0)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= budget)
    ranked = ranked.filter(F.col("place") <= limit)
    of = Window.partitionBy("section", "severity").orderBy("place")
    detail = (F.col("section") == "production") & (F.col("severity").isin(*SEVERITIES[:2])) & (F.row_number().over(of) <= DETAILS)
    return ranked.withColumn("detailed", detail).select("section", "place", "severity", "detailed", "rule_id", "file_path", "line_start", "message", "snippet", "fix_hint", "confidence")


def comment(v: DataFrame, status: str) -> str:
    counts = {r["section"]: r["n"] for r in v.groupBy(F.when(F.col("confidence") < 0.5, "low").when(F.col("in_test_file"), "test").otherwise("production").alias("section")).agg(F.count(F.lit(1)).alias("n")).collect()}
    lines, last = [f"## {STATUS_MARK.get(status, '')} Scan {status}", f"{sum(counts.values())} findings"], None
    for r in comment_rows(v).orderBy("section", "place").collect():
        if r["section"] != last:
            last = r["section"]
            lines += ["", f"### {last} ({counts[last]})"]
        lines.append(f"- {SEVERITY_MARK[r['severity']]} **{r['severity']}** `{r['file_path']}:{r['line_start']}` {r['message']}")
        if r["detailed"]:
            lines += [f"  > `{r['snippet']}`", *([f"  > {r['fix_hint']}"] if r["fix_hint"] else [])]
    return "\n".join(lines)


def ci_lines(v: DataFrame, fail_on: str = "CRITICAL") -> DataFrame:
    kind = F.when(severity_rank(F.col("severity")) <= SEVERITIES.index(fail_on), "error").otherwise("warning")
    return v.select(*_order(v), F.concat(F.lit("::"), kind, F.lit(" file="), "file_path", F.lit(",line="), F.col("line_start").cast("string"), F.lit("::["), "rule_id", F.lit("] "), F.substring("message", 1, 200)).alias("ci"))


def baseline_document(v: DataFrame, created: str) -> Iterator[str]:
    """The document in pieces, a partition of violations at a time: the driver never holds them all."""
    from .scan import baseline_of

    yield json.dumps({"version": 1, "created": created, "total": v.count()})[:-1] + ', "violations": ['
    for i, r in enumerate(baseline_of(v).toLocalIterator()):
        yield (", " if i else "") + json.dumps(r.asDict())
    yield "]}"


def result_json(v: DataFrame) -> DataFrame:
    return v.select(F.to_json(F.struct(*[c for c in v.columns if c != "seq"])).alias("violation"))


def document_rows(v: DataFrame, kind: str) -> DataFrame:
    """``seq`` or the columns of the order, and ``line``: the rows of a document of a kind (json, sarif, baseline, table) as text."""
    order = _order(v)
    if kind == "sarif":
        return sarif_results(v).withColumnRenamed("result", "line")
    if kind == "baseline":
        known = F.struct(text.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet")).alias("fingerprint"), F.col("rule_id"), F.col("file_path").alias("file"), F.col("line_start").alias("line"), F.substring("message", 1, 200).alias("message"))
        return v.select(*order, F.to_json(known).alias("line"))
    if kind == "json":
        return v.select(*order, F.to_json(F.struct(*[c for c in v.columns if c != "seq"])).alias("line"))
    rows = with_place(v, "__place")
    where = F.concat("file_path", F.lit(":"), F.col("line_start").cast("string"))
    return rows.select(*order, F.concat(F.lpad((F.col("__place") + 1).cast("string"), 4, " "), F.lit("  "), F.rpad("severity", 8, " "), F.lit("  "), where, F.lit("  "), "rule_id", F.lit("  "), "message").alias("line"))


def terminal_table(v: DataFrame) -> Iterator[str]:
    """A line a violation, in order and all of them, a partition at a time."""
    for i, r in enumerate(v.orderBy(*_order(v)).toLocalIterator(), 1):
        yield f"{i:>4}  {r['severity']:<8}  {r['file_path']}:{r['line_start']}  {r['rule_id']}  {r['message']}"


def append_run(summary: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add the rows of a run. With ``run_id`` they are that run's own part of the table: writing it again replaces it, so a run that is
    repeated after a failure is there once."""
    if run_id is None:
        summary.write.mode("append").parquet(path)
    else:
        rows = summary.withColumn("run_id", F.lit(run_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Upsert by aggregation: of each key the row with the greatest ``by``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), by).alias("r")).select("r.*")
