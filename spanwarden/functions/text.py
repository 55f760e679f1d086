"""Text functions: lines, stripping, redaction, fingerprints, rule ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
REDACTED = "[REDACTED]"
#: What looks like a secret, replaced one after the other.
SECRETS = (
    r"(?i)(?:api[_-]?key|secret[_-]?key|auth[_-]?token|access[_-]?token|private[_-]?key|password|passwd|credential|bearer)\s*[:=]\s*['\"][^'\"]{8,}['\"]",
    r"(?i)(?:key|token|secret|password)\s*[:=]\s*['\"][A-Za-z0-9+/=_\-]{20,}['\"]",
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9_]{36,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}",
    r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----",
)
#: Parts of a rule id (or the tag "secrets") that make its snippets redacted.
SECRET_RULES = ("secret", "password", "key", "token", "credential", "pem", "jwt")


def strip(text: Column) -> Column:
    """All Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def explode_lines(files: DataFrame, text: str = "content", *keep: str) -> DataFrame:
    """A row per line with its number from 1; no empty line after a final line break."""
    cols = keep or tuple(c for c in files.columns if c != text)
    parts = F.split(F.coalesce(F.col(text), F.lit("")), LINE_BREAK)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return files.select(*cols, F.posexplode(parts).alias("__at", "line")).select(*cols, (F.col("__at") + 1).alias("line_no"), "line")


def all_matches(rows: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """key, nth (from 0), at (letter from 1), line (by line feeds, from 1), match: all matches in each row's text, as a search from left to right finds them.

    What stands between the matches tells where they are: gaps and matches alternate, so running lengths are places. The pattern is Java's and must
    not match nothing. ``key`` names a row.
    """
    text_, found = F.coalesce(F.col(column), F.lit("")), F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(pattern), 0)
    gaps = F.split(text_, pattern, -1)
    cut = rows.filter(text_.rlike(pattern)).select(key, F.posexplode(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"))).alias("nth", "m")).select(key, "nth", "m.gap", "m.match")
    breaks = lambda c: F.length(c) - F.length(F.replace(c if isinstance(c, Column) else F.col(c), F.lit("\n"), F.lit("")))
    before = Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    passed = lambda f: F.coalesce(F.sum(f("gap") + f("match")).over(before), F.lit(0)) + f("gap") + 1
    return cut.select(key, "nth", passed(F.length).cast("int").alias("at"), passed(breaks).cast("int").alias("line"), "match")


def redact_secrets(text: Column) -> Column:
    for p in SECRETS:
        text = F.regexp_replace(text, p, F.lit(REDACTED.replace("$", r"\$")))
    return text


def redacts(rule_id: str, tags: tuple[str, ...] = ()) -> bool:
    return "secrets" in tags or any(k in rule_id.lower() for k in SECRET_RULES)


def fingerprint(rule_id: Column, path: Column, snippet: Column) -> Column:
    """16 hex digits that survive a move to another line."""
    return F.substring(F.sha2(F.concat_ws("|", rule_id, F.replace(path, F.lit("\\"), F.lit("/")), F.lower(strip(F.coalesce(snippet, F.lit(""))))), 256), 1, 16)


def pack_of(rule_id: Column) -> Column:
    return F.regexp_replace(rule_id, "/[^/]*$", "")


def slug_of(rule_id: Column) -> Column:
    return F.substring_index(rule_id, "/", -1)


def numbered(lines: DataFrame, by: str) -> DataFrame:
    """Per file its source with line numbers, and an estimate of its tokens (a quarter of its length)."""
    said = F.sort_array(F.collect_list(F.struct("line_no", F.format_string("%4d | %s", F.col("line_no"), F.col("line")).alias("s"))))
    return lines.groupBy(by).agg(F.array_join(F.transform(said, lambda x: x["s"]), "\n").alias("numbered"))


def token_estimate(content: Column) -> Column:
    return F.floor(F.length(content) / 4).cast("int")


def model_from_table(table: Column) -> Column:
    """customer_orders -> CustomerOrder."""
    return F.array_join(F.transform(F.split(F.regexp_replace(table, "s+$", ""), "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))
