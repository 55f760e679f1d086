"""Rule packs: YAML to checked rules, and the translation of their regexes to Java's dialect."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import yaml

from ..schemas import SEVERITIES

KINDS = ("pattern", "ast", "llm", "dependency")
MODES = ("search", "taint")


class RuleLoadError(ValueError):
    """A pack that cannot be used, said in words for its author."""


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    type: str
    severity: str
    message: str
    enabled: bool = True
    skip_tests: bool = False
    fix_hint: str | None = None
    references: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    query: str | None = None
    name_regex: str | None = None
    must_not_contain: str | None = None
    prompt: str | None = None
    examples: tuple[Any, ...] = ()
    checks: tuple[Any, ...] = ()
    mode: str = "search"
    sources: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()
    sanitizers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pack:
    id: str
    version: str
    name: str
    rules: tuple[Rule, ...] = ()
    description: str = ""
    manifest: dict = field(default_factory=dict)

    def full_id(self, rule: Rule) -> str:
        return f"{self.id}/{rule.id}"


def _rule(raw: Any, at: str) -> Rule:
    if not isinstance(raw, dict):
        raise RuleLoadError(f"{at}: a rule must be a mapping")
    kind = raw.get("type")
    if kind not in KINDS:
        raise RuleLoadError(f"{at}: unknown rule type {kind!r}; one of {', '.join(KINDS)} is expected")
    if raw.get("mode", "search") not in MODES:
        raise RuleLoadError(f"{at}: mode {raw['mode']!r} is none of {', '.join(MODES)}")
    searched = ("sources", "sinks") if raw.get("mode") == "taint" and "patterns" not in raw else ("patterns",)
    needed = {"pattern": ("languages", *searched), "ast": ("languages", "query"), "llm": ("languages", "prompt"), "dependency": ("checks",)}[kind]
    for key in ("id", "name", "severity", "message", *needed):
        if raw.get(key) in (None, ""):
            raise RuleLoadError(f"{at}: field '{key}' is missing")
    if raw["severity"] not in SEVERITIES:
        raise RuleLoadError(f"{at}: severity {raw['severity']!r} is none of {', '.join(SEVERITIES)}")
    known = Rule.__dataclass_fields__
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known and v is not None}
    return Rule(**values)


def load_pack(path: str | Path) -> Pack:
    path = Path(path)
    if not path.is_file():
        raise RuleLoadError(f"{path}: no such file")
    return pack_of_text(path.read_text(encoding="utf-8"), str(path))


def pack_of_text(said: str, path: str) -> Pack:
    """A pack from its YAML; ``path`` is named in errors."""
    try:
        raw = yaml.safe_load(said)
    except yaml.YAMLError as e:
        raise RuleLoadError(f"{path}: not valid YAML: {e}") from e
    if not isinstance(raw, dict):
        raise RuleLoadError(f"{path}: a pack must be a mapping")
    manifest = raw.get("manifest")
    if not isinstance(manifest, dict):
        raise RuleLoadError(f"{path}: 'manifest' is missing")
    for key in ("id", "version", "name"):
        if not manifest.get(key):
            raise RuleLoadError(f"{path}: manifest field '{key}' is missing")
    rules = raw.get("rules") or []
    if not isinstance(rules, list):
        raise RuleLoadError(f"{path}: 'rules' must be a list")
    return Pack(manifest["id"], str(manifest["version"]), manifest["name"], tuple(_rule(r, f"{path}, rule {i + 1}") for i, r in enumerate(rules)), manifest.get("description", ""), manifest)


def load_pack_directory(path: str | Path) -> list[Pack]:
    """All ``*.yml`` below, in order of path; index files (``_pack.yml``) are left out. A missing folder holds no packs."""
    path = Path(path)
    return [load_pack(p) for p in sorted(path.rglob("*.yml")) if p.name != "_pack.yml"] if path.is_dir() else []


class LocalPackSource:
    def __init__(self, path: str | Path):
        self.path = path

    def load(self) -> list[Pack]:
        return load_pack_directory(self.path)


class RemotePackSource:
    def load(self) -> list[Pack]:
        raise NotImplementedError("remote packs are not available")


def java_regex(pattern: str) -> str | None:
    """The pattern for Java, without case and with Unicode classes; None for what Java has no form of."""
    if re.search(r"\(\?\(", pattern):
        return None
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'U')}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\\\k<{m[1].replace('_', 'U')}>".replace("\\\\", "\\"), pattern)
    pattern = re.sub(r"(?<!\\)\\Z", r"\\z", pattern)
    return "(?iU)" + pattern


def required(pattern: str) -> tuple[str, ...] | None:
    """Words in small letters one of which stands in whatever the pattern matches (case aside); None where nothing of the kind can be told."""
    from re import _constants as kinds
    from re import _parser

    def better(a, b):
        """The choice whose shortest word is longer; among equals the smaller one."""
        if not a or not b:
            return a or b
        return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))

    def of(items):
        best, run = None, ""
        for kind, value in [*items, (None, None)]:
            if kind is kinds.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            best, run, found = better(best, {run} if run else None), "", None
            if kind is kinds.SUBPATTERN:
                found = of(value[3])
            elif kind is kinds.BRANCH:
                ways = [of(way) for way in value[1]]
                found = set().union(*ways) if all(ways) else None
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
                found = of(value[2])
            elif kind is kinds.ATOMIC_GROUP:
                found = of(value)
            elif kind is kinds.ASSERT and value[0] > 0:
                found = of(value[1])
            best = better(best, found)
        return best

    try:
        found = of(_parser.parse(pattern, re.IGNORECASE))
    except (re.error, RecursionError, OverflowError):
        return None
    return tuple(sorted(found)) if found and len(found) <= 24 else None


def any_of(words) -> str:
    """A regex that finds any of the words, whose cost at a letter does not grow with their number: they are a tree by their letters."""
    tree: dict = {}
    for w in sorted(words):
        at = tree
        for c in w:
            if "" in at:
                break  # a word that starts with a found one adds nothing
            at = at.setdefault(c, {})
        else:
            at.clear()
            at[""] = {}
    quoted = lambda c: re.escape(c) if c.isascii() and not c.isalnum() else c

    def said(node: dict) -> str:
        ways = [quoted(c) + said(below) for c, below in node.items() if c]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""

    first = "".join(quoted(c) if c not in "^-]" else f"\\{c}" for c in tree if c)
    return f"(?=[{first}]){said(tree)}"


def checked(rule: Rule, spark=None) -> Rule | None:
    """The rule without malformed regexes, each of which is warned of; None when none is left."""

    def good(p: str) -> bool:
        try:
            re.compile(p, re.IGNORECASE)
            if spark is not None and (j := java_regex(p)):
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(j)
            return True
        except Exception as e:  # noqa: BLE001  either engine's complaint
            warnings.warn(f"rule {rule.id}: pattern {p!r} is malformed and left out ({str(e).splitlines()[0]})", stacklevel=2)
            return False

    patterns = tuple(p for p in rule.patterns if good(p))
    return replace(rule, patterns=patterns, exclude_patterns=tuple(p for p in rule.exclude_patterns if good(p))) if patterns else None


def rule_table(spark, packs: list[Pack]):
    """Rules as rows: pack_id, rule_id, and the descriptive fields."""
    rows = [(p.id, p.full_id(r), r.name, r.type, r.severity, r.enabled, r.skip_tests, r.message, r.fix_hint, list(r.languages), list(r.patterns), list(r.exclude_patterns), list(r.tags)) for p in packs for r in p.rules]
    return spark.createDataFrame(rows, "pack_id string, rule_id string, name string, type string, severity string, enabled boolean, skip_tests boolean, message string, fix_hint string, languages array<string>, patterns array<string>, exclude_patterns array<string>, tags array<string>")
