"""Rules of type ``dependency``: declared packages whose version is not above a bound.

``version_key`` turns a version into a string that sorts as versions do, so the bound is a range condition of an equi-join on ecosystem and package;
everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schemas import SEVERITIES
from .rules import Pack
from .scan import DIRECTIVE, with_context

_RELEASE = r"^\s*[=v]*(?:(\d+)!)?(\d+(?:\.\d+)*)"
_PRE = r"^[-_.]?(alpha|beta|preview|pre|rc|a|b|c)(?![a-z])[-_.]?(\d*)"
_POST = r"(?:^|(?<=\d))(?:[-_.]?(?:post|rev|r)(?![a-z])[-_.]?(\d*)|-(\d+)(?:$|(?=[-_.])))"
_DEV = r"[-_.]?dev[-_.]?(\d*)"


def _number(digits: Column) -> Column:
    """Digits so that longer numbers come later; nothing is 0."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 3, "0"), bare)


def version_key(version: Column) -> Column:
    """A string in the order of versions; null where there is no number.

    Epoch, then release (parts that are zero at the end do not count), then dev releases, pre-releases (alpha, beta, candidates;
    a word of another kind comes before these), the release itself, post-releases. What follows a plus sign does not count.
    """
    v = F.regexp_replace(F.lower(version), r"\s+|\+.*$", "")
    release = F.regexp_extract(v, _RELEASE, 2)
    rest = F.regexp_replace(v, _RELEASE, "")
    parts = F.transform(F.split(F.regexp_replace(release, r"(?:\.0+)+$", ""), r"\."), _number)
    word, post = F.regexp_extract(rest, _PRE, 1), rest.rlike(_POST)
    after_pre = F.regexp_replace(rest, _PRE, "")
    dev, stage = rest.rlike(_DEV), F.substring(word, 1, 1)
    stage = F.when(word.isin("preview", "pre", "rc"), "c").otherwise(stage)
    other = ~post & ~dev & rest.rlike(r"^[-_.]?[a-z]")
    phase = F.when(word != "", F.concat(stage, _number(F.regexp_extract(rest, _PRE, 2)))).when(other, F.concat(F.lit("A"), rest)).when(dev & ~post, F.lit("0")).otherwise(F.lit("z"))
    later = F.when(after_pre.rlike(_POST), F.concat(F.lit("1"), _number(F.concat(F.regexp_extract(after_pre, _POST, 1), F.regexp_extract(after_pre, _POST, 2))))).otherwise("0")
    early = F.when(dev, F.concat(F.lit("0"), _number(F.regexp_extract(rest, _DEV, 1)))).otherwise("1")
    return F.when(release != "", F.concat(_number(F.regexp_extract(v, _RELEASE, 1)), F.lit("!"), F.array_join(parts, "."), F.lit("!"), phase, F.lit("!"), later, F.lit("!"), early))


def package_key(package: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(package)), r"[-_.]+", "-")


#: Manifests by ecosystem: the pattern of their path, and how a line of theirs declares a package and a version.
_LINES = {
    "python": (r"(?:^|/)(?:requirements[^/]*\.txt|Pipfile|pyproject\.toml|setup\.cfg)$", r"""^\s*['"]?([A-Za-z][\w.-]*)(?:\[[^\]]*\])?['"]?\s*(?=[=~<>!^,;#'"]|$)""", r"""[=~<>!^]+\s*['"]?[~^<>=]*\s*(v?\d[\w.!+-]*)"""),
    "csharp": (r"\.csproj$", r'<PackageReference\s+Include="([^"]+)"', r'Version="([^"]*)"'),
    "ruby": (r"(?:^|/)Gemfile$", r"""^\s*gem\s+['"]([\w-]+)['"]""", r"""['"]\s*,\s*['"][~>=<\s]*(\d[\w.-]*)"""),
    "go": (r"(?:^|/)go\.mod$", r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[^\s]+)\s+v", r"\sv(\d[\w.+-]*)"),
}
#: Manifests in JSON: the pattern of their path, and the sections that map packages to versions.
_SECTIONS = {"javascript": (r"(?:^|/)package\.json$", ("dependencies", "devDependencies")), "php": (r"(?:^|/)composer\.json$", ("require", "require-dev"))}


def declared(files: DataFrame) -> DataFrame:
    """file_path, language, package, version (null if none is said), line_no, line: a row for each declaration.

    A line of a plain manifest declares one package. In JSON the sections of dependencies count, whatever else looks like them; a package stands
    where its name is first a key.
    """
    out = None
    for language, (where, package, version) in _LINES.items():
        rows = text.explode_lines(files.filter(F.col("file_path").rlike(where)).select("file_path", "content"))
        said = F.regexp_extract("line", version, 1)
        rows = rows.select("file_path", F.lit(language).alias("language"), F.regexp_extract("line", package, 1).alias("package"), F.nullif(said, F.lit("")).alias("version"), "line_no", "line")
        rows = rows.filter(F.col("package") != "")
        out = rows if out is None else out.unionByName(rows)
    for language, (where, sections) in _SECTIONS.items():
        mine = files.filter(F.col("file_path").rlike(where)).select("file_path", "content")
        parsed = F.from_json("content", ", ".join(f"`{s}` map<string,string>" for s in sections))
        entries = F.flatten(F.array(*[F.coalesce(F.map_entries(parsed[s]), F.array().cast("array<struct<key:string,value:string>>")) for s in sections]))
        rows = mine.select("file_path", F.regexp_replace("content", r'"[ \t]*:', '":').alias("content"), F.explode(F.array_distinct(entries)).alias("e"))
        at = F.instr(F.col("content"), F.concat(F.lit('"'), F.col("e.key"), F.lit('":')))
        rows = rows.withColumn("line_no", F.regexp_count(F.substring(F.col("content"), F.lit(1), at), F.lit("\n")) + 1)
        said = F.regexp_extract("e.value", r"^[\^~>=<v\s]*(\d\S*)", 1)
        rows = rows.select("file_path", F.lit(language).alias("language"), F.col("e.key").alias("package"), F.nullif(said, F.lit("")).alias("version"), "line_no", F.coalesce(F.get(F.split("content", "\n"), F.col("line_no") - 1), F.lit("")).alias("line"))
        out = out.unionByName(rows)
    return out


def scan_dependencies(files: DataFrame, packs: list[Pack], keyword: str = DIRECTIVE) -> DataFrame | None:
    """Violations of all rules of type ``dependency``, in the columns of ``scan.scan``; None if there is none.

    A check hits its package at any version up to ``max_version``, or at any at all if it has none. A declaration without a version is hit only by a check
    without a bound. The checks are rows of the rules' files, so they are broadcast.
    """
    checks = [
        (number, order, pack.full_id(rule), rule.name, rule.severity, rule.message, rule.fix_hint, list(rule.references), rule.skip_tests, c["package"], c.get("language", "python"), None if c.get("max_version") is None else str(c["max_version"]), c.get("reason", ""))
        for number, pack in enumerate(packs) for order, rule in enumerate(pack.rules) if rule.type == "dependency" and rule.enabled for c in rule.checks
    ]
    if not checks:
        return None
    schema = "pack int, rule int, rule_id string, rule_name string, own_severity string, text string, fix_hint string, references array<string>, skip_tests boolean, checked string, language string, max_version string, reason string"
    table = files.sparkSession.createDataFrame(checks, schema)
    table = table.withColumns({"key": package_key(F.col("checked")), "bound": version_key(F.col("max_version"))}).withColumnRenamed("language", "ecosystem")
    rows = declared(files).withColumns({"declared_key": package_key(F.col("package")), "at": version_key(F.col("version"))})
    on = (F.col("language") == F.col("ecosystem")) & (F.col("declared_key") == F.col("key")) & (F.col("max_version").isNull() | (F.col("at") <= F.col("bound")))
    hit = with_context(rows.join(F.broadcast(table), on).drop("language"))
    hit = hit.filter(~(F.col("skip_tests") & F.col("in_test_file")))
    hit = hit.filter(~_suppressed(keyword))
    message = F.col("text")
    for name, value in (("{file}", F.col("file_path")), ("{line}", F.col("line_no").cast("string")), ("{match}", F.concat_ws(" ", "package", "version")), ("{reason}", F.col("reason"))):
        message = F.replace(message, F.lit(name), value)
    cap = F.when(F.col("in_test_file") & F.col("own_severity").isin(*SEVERITIES[:2]), "MEDIUM").otherwise(F.col("own_severity"))
    start = F.instr(F.col("line"), F.col("package"))
    return hit.select(
        "rule_id", "rule_name", cap.alias("severity"), "file_path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), start.alias("col_start"), (start + F.length("package")).cast("int").alias("col_end"),
        message.alias("message"), F.substring(text.strip(F.col("line")), 1, 200).alias("snippet"), "fix_hint", "references", F.when(F.col("confidence") == paths.PATTERN_CONFIDENCE, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), "in_test_file",
        F.struct(F.col("pack"), F.col("file_path").alias("file"), F.col("rule"), F.col("line_no").alias("line")).alias("seq"),
    )


def _suppressed(keyword: str) -> Column:
    """A directive for everything, for the rule in full or for its last part."""
    named = F.regexp_extract("line", r"(?iU)(?:#|//)\s*" + keyword.replace(":", "[:]") + r"(?:=\s*([\w/,.\-\s]+))?", 1)
    there = F.col("line").rlike(r"(?iU)(?:#|//)\s*" + keyword.replace(":", "[:]"))
    ids = F.transform(F.split(named, ","), text.strip)
    return there & ((named == "") | F.array_contains(ids, F.col("rule_id")) | F.array_contains(ids, text.slug_of(F.col("rule_id"))))
