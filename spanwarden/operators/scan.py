"""The rule scan: lines and constant-regex rules to violations, without any theta join.

Each pack is one narrow projection: lines that no pattern matches go first, then an array of one struct a rule is filtered and inlined. A regex is
tried only where the line has one of the words that its matches must have, so rules whose words are absent cost a search for
bytes each. Nothing is shuffled; rules are folded into the plan on the driver.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schemas import SEVERITIES, severity_rank
from .rules import Pack, Rule, any_of, checked, java_regex, required

DIRECTIVE = "scan:disable"
NOQA = r"(?iU)(?:#|//)\s*noqa(?::\s*([\w/,.\-\s]+))?"


def _ids(found: Column) -> Column:
    return F.transform(F.split(found, ","), text.strip)


def noqa_suppresses(line: Column, full_id: str) -> Column:
    """A bare marker hides all rules; a list hides the rules named in full."""
    named = F.regexp_extract(line, NOQA, 1)
    return line.rlike(NOQA) & ((named == "") | F.array_contains(_ids(named), full_id))


def directive_suppresses(line: Column, full_id: str, keyword: str = DIRECTIVE) -> Column:
    """Like noqa, but the last part of an id will do."""
    p = r"(?iU)(?:#|//)\s*" + re.escape(keyword) + r"(?:=\s*([\w/,.\-\s]+))?"
    named = F.regexp_extract(line, p, 1)
    return line.rlike(p) & ((named == "") | F.array_contains(_ids(named), full_id) | F.array_contains(_ids(named), full_id.rsplit("/", 1)[-1]))


def _first(rule: Rule, value) -> Column:
    """``value(pattern)`` of the first pattern, in the rule's order, that the line matches."""
    line, out = F.col("line"), None
    for p in map(java_regex, rule.patterns):
        out = F.when(line.rlike(p), value(p)) if out is None else out.when(line.rlike(p), value(p))
    return out


_LOW, _ODD = "__low", "__odd"
#: Letters that match an ASCII letter when case does not count, without having it as their small letter.
ODD_LETTERS = "[\u017f\u0131\u0130]"


def _words_in(pattern: str) -> Column:
    """Whether the line has a word that every match of the pattern has; true where there is none, and for lines with odd letters."""
    words = required(pattern)
    return reduce(or_, [F.col(_ODD), *[F.col(_LOW).contains(w) for w in words]]) if words else F.lit(True)


def _may_match(patterns: list[str]) -> Column:
    """One search for all words; patterns without a word are tried themselves."""
    words = {p: required(p) for p in patterns}
    known = sorted({w for found in words.values() for w in found or ()})
    bare = [F.col("line").rlike(java_regex(p)) for p, found in words.items() if not found]
    return reduce(or_, [*([F.col(_ODD) | F.col(_LOW).rlike(any_of(known))] if known else []), *bare])


def _candidate(pack: Pack, rule: Rule, order: int, redact_message: bool, keyword: str) -> Column:
    line, full_id = F.col("line"), pack.full_id(rule)
    start = _first(rule, lambda p: F.regexp_instr(line, F.lit(p)))
    match = _first(rule, lambda p: F.regexp_substr(line, F.lit(p)))
    secret = text.redacts(rule.id, rule.tags)
    shown = F.lit(text.REDACTED) if secret and redact_message else match
    message = F.lit(rule.message)
    for name, value in (("{file}", F.col("file_path")), ("{line}", F.col("line_no").cast("string")), ("{match}", shown)):
        message = F.replace(message, F.lit(name), value)
    snippet = F.concat(F.substring(line, F.lit(1), start - 1), F.lit(text.REDACTED), F.substring(line, start + F.length(match), F.length(line))) if secret else line
    ok = F.lit(True)
    if rule.skip_tests:
        ok = ok & ~F.col("in_test_file")
    if "*" not in rule.languages:
        ok = ok & F.coalesce(F.col("language").isin(*rule.languages), F.lit(False))
    ok = ok & start.isNotNull()
    for p in map(java_regex, rule.exclude_patterns):
        ok = ok & ~line.rlike(p)
    ok = ok & ~noqa_suppresses(line, full_id) & ~directive_suppresses(line, full_id, keyword)
    severity = F.when(F.col("in_test_file") & F.lit(SEVERITIES.index(rule.severity) < 2), F.lit("MEDIUM")).otherwise(F.lit(rule.severity))
    return F.when(
        ok,
        F.struct(
            F.lit(order).alias("rule_seq"), F.lit(full_id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), severity.alias("severity"), start.alias("col_start"), (start + F.length(match)).cast("int").alias("col_end"),
            message.alias("message"), F.substring(text.strip(snippet), 1, 200).alias("snippet"), F.lit(rule.fix_hint).cast("string").alias("fix_hint"),
            F.array(*map(F.lit, rule.references)).cast("array<string>").alias("references"),
        ),
    )


def with_context(files: DataFrame) -> DataFrame:
    p = F.col("file_path")
    return files.withColumns({"language": paths.detect_language(p), "in_test_file": paths.is_test_file(p), "confidence": paths.confidence(p)})


def scan(files: DataFrame, packs: list[Pack], ignore: tuple[str, ...] = (), redact_message: bool = True, keyword: str = DIRECTIVE, lines: DataFrame | None = None) -> DataFrame:
    """Violations of all pattern rules. ``files``: file_path, content. ``seq`` keeps the order pack, file, rule, line."""
    spark = files.sparkSession
    kept = files.filter(~paths.is_ignored(F.col("file_path"), ignore)) if ignore else files
    if lines is None:
        lines = text.explode_lines(with_context(kept.select("file_path", "content")))
    # small letters are made once a line: as the column of a generator the optimizer does not copy them into every condition
    lines = lines.select("*", F.inline(F.array(F.struct(F.lower("line").alias(_LOW), F.col("line").rlike(ODD_LETTERS).alias(_ODD)))))
    out = None
    for number, pack in enumerate(packs):
        rules = [r for r in (checked(x, spark) for x in pack.rules if x.type == "pattern" and x.enabled) if r]
        rules = [r for r in rules if all(java_regex(p) for p in (*r.patterns, *r.exclude_patterns))]
        if not rules:
            continue
        some = lines.filter(_may_match([p for r in rules for p in r.patterns]))
        found = F.filter(F.array(*[F.when(reduce(or_, [_words_in(p) for p in r.patterns]), _candidate(pack, r, i, redact_message, keyword)) for i, r in enumerate(rules)]), lambda v: v.isNotNull())
        rows = some.select("file_path", "line_no", "in_test_file", "confidence", F.inline(found))
        rows = rows.select(
            "rule_id", "rule_name", "severity", "file_path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "col_start", "col_end", "message", "snippet", "fix_hint", "references", "confidence", "in_test_file",
            F.struct(F.lit(number).alias("pack"), F.col("file_path").alias("file"), F.col("rule_seq").alias("rule"), F.col("line_no").alias("line")).alias("seq"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no pattern rule can be used")
    return out


def baseline_of(violations: DataFrame) -> DataFrame:
    v = violations
    return v.select(text.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet")).alias("fingerprint"), "rule_id", F.col("file_path").alias("file"), F.col("line_start").alias("line"), F.substring("message", 1, 200).alias("message"))


def without_known(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    """Violations whose fingerprint is not in the baseline; repeated ones all stay."""
    keyed = violations.withColumn("fingerprint", text.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet")))
    return keyed.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def by_severity(violations: DataFrame) -> DataFrame:
    """Counts of all five severities, zeros too."""
    spark = violations.sparkSession
    all_ = spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")
    return all_.join(violations.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_pack(violations: DataFrame) -> DataFrame:
    return violations.groupBy(text.pack_of(F.col("rule_id")).alias("pack_id")).agg(F.count(F.lit(1)).alias("n"))


def gate(violations: DataFrame, fail_on: str = "CRITICAL", warn_on: str = "HIGH") -> DataFrame:
    """One row: passed, warned or failed, and the number of violations."""
    worst = violations.agg(F.min(severity_rank(F.col("severity"))).alias("worst"), F.count(F.lit(1)).alias("total"))
    status = F.when(F.col("worst") <= SEVERITIES.index(fail_on), "failed").when(F.col("worst") <= SEVERITIES.index(warn_on), "warned").otherwise("passed")
    return worst.select(status.alias("status"), F.col("total").alias("total_violations"))
