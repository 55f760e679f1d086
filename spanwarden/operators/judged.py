"""Post-processing of recorded model answers, all relational, and the guard around a model that is called."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .scan import DIRECTIVE, NOQA, _ids
from ..functions import text

ANSWER = "violations array<struct<rule_id:string,line_start:int,line_end:int,message:string,confidence:double,snippet:string>>"
REVIEW = "reviewed array<struct<rule_id:string,line_start:int,verdict:string,adjusted_confidence:double,reason:string>>"


def parse(answers: DataFrame, column: str, schema: str) -> DataFrame:
    """One row per finding with its place; answers that are not JSON of the schema give none."""
    field = schema.split(" ", 1)[0]
    return answers.select(*[c for c in answers.columns if c != column], F.posexplode(F.from_json(column, schema)[field]).alias("seq", "f")).select("*", "f.*").drop("f")


def critic_keeps(candidates: DataFrame, reviewed: DataFrame, by: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Candidates that the critic kept, with the confidence of its last word on them (0.7 where it gives none)."""
    keys = [*by, "rule_id", "line_start"]
    kept = reviewed.filter(F.lower("verdict") == "keep").groupBy(*keys).agg(F.max_by(F.coalesce("adjusted_confidence", F.lit(0.7)), "seq").alias("confidence"))
    return candidates.drop("confidence").join(kept, keys)


def findings(kept: DataFrame, rules: DataFrame, line_counts: DataFrame) -> DataFrame:
    """Findings of known rules, clamped to their file's lines, with the confidence of their path; weak ones in production go."""
    out = kept.join(F.broadcast(rules.select("rule_id", "name", "severity", "fix_hint")), "rule_id").join(line_counts, "file_path")
    n = F.greatest(F.col("n_lines"), F.lit(1))
    start = F.greatest(F.lit(1), F.least("line_start", n))
    out = out.withColumn("line_start", start).withColumn("line_end", F.greatest("line_start", F.least(F.coalesce("line_end", "line_start"), n)))
    test, migration = paths.is_test_file(F.col("file_path")), paths.is_migration_file(F.col("file_path"))
    capped = F.when(test, F.least("confidence", F.lit(paths.TEST_CONFIDENCE))).when(migration, F.least("confidence", F.lit(paths.MIGRATION_CONFIDENCE))).otherwise(F.col("confidence"))
    return out.withColumn("exempt", test | migration).withColumn("confidence", capped).filter(F.col("exempt") | (F.col("confidence") >= 0.6)).drop("exempt", "n_lines")


def not_suppressed(found: DataFrame, lines: DataFrame, keyword: str = DIRECTIVE) -> DataFrame:
    """Drop findings whose first line carries a marker for them; the rule is a column here."""
    at = found.join(lines.select("file_path", F.col("line_no").alias("line_start"), "line"), ["file_path", "line_start"], "left")
    line = F.coalesce(F.col("line"), F.lit(""))
    directive = r"(?iU)(?:#|//)\s*" + keyword + r"(?:=\s*([\w/,.\-\s]+))?"
    a, b = F.regexp_extract(line, NOQA, 1), F.regexp_extract(line, directive, 1)
    hidden = (line.rlike(NOQA) & ((a == "") | F.array_contains(_ids(a), F.col("rule_id")))) | (line.rlike(directive) & ((b == "") | F.array_contains(_ids(b), F.col("rule_id")) | F.array_contains(_ids(b), text.slug_of(F.col("rule_id")))))
    return at.filter(~hidden).drop("line")


def enhance(violations: DataFrame, answers: DataFrame) -> DataFrame:
    """Apply answers by place within their file: false positives lose 0.5 of confidence (0.1 stays); hints and references are added."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("seq")) - 1
    v = violations.withColumn("idx", place).join(answers, ["file_path", "idx"], "left")
    fp = F.coalesce(F.col("false_positive"), F.lit(False))
    return v.withColumns({
        "confidence": F.when(fp, F.greatest(F.lit(0.1), F.col("confidence") - 0.5)).otherwise(F.col("confidence")),
        "message": F.when(F.col("reason").isNotNull(), F.concat("message", F.lit(" ("), "reason", F.lit(")"))).otherwise(F.col("message")),
        "fix_hint": F.coalesce("better_hint", "fix_hint"),
        "references": F.when(F.col("reference").isNotNull(), F.array_append("references", F.col("reference"))).otherwise(F.col("references")),
    }).drop("idx", "false_positive", "reason", "better_hint", "reference")


def within_budget(files: DataFrame, tokens: int = 4000) -> DataFrame:
    return files.filter(text.token_estimate(F.col("content")) <= tokens)


class Guard:
    """Circuit breaker and token bucket around a call: one per executor process."""

    def __init__(self, failures: int = 3, rest: float = 60.0, calls: int = 10, period: float = 60.0, max_wait: float = 120.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.failures, self.rest, self.calls, self.period, self.max_wait, self.clock, self.sleep = failures, rest, calls, period, max_wait, clock, sleep
        self.state, self.failed, self.opened, self.stamps = "closed", 0, 0.0, []

    def allows(self) -> bool:
        if self.state == "open" and self.clock() - self.opened >= self.rest:
            self.state = "half-open"
        return self.state != "open"

    def __call__(self, f: Callable, *args):
        if not self.allows():
            return None
        now = self.clock()
        self.stamps = [t for t in self.stamps if now - t < self.period]
        if len(self.stamps) >= self.calls:
            wait = self.period - (now - self.stamps[0])
            if wait > self.max_wait:
                return None
            self.sleep(wait)
        self.stamps.append(self.clock())
        try:
            out = f(*args)
        except Exception:
            self.failed += 1
            if self.state == "half-open" or self.failed >= self.failures:
                self.state, self.opened = "open", self.clock()
            raise
        self.state, self.failed = "closed", 0
        return out


def judge(numbered_files: DataFrame, call: Callable[[str, str], str], column: str = "numbered") -> DataFrame:
    """file_path, answer: the model's raw answer for each file (null when it fails or the guard refuses)."""
    import pandas as pd

    def run(batches):
        guard = Guard()
        for pdf in batches:
            said = []
            for path, body in zip(pdf["file_path"], pdf[column], strict=True):
                try:
                    said.append(guard(call, path, body))
                except Exception:  # noqa: BLE001  a failed call is an absent answer
                    said.append(None)
            yield pd.DataFrame({"file_path": pdf["file_path"], "answer": said})

    return numbered_files.select("file_path", column).mapInPandas(run, "file_path string, answer string")
