"""Rules of ``mode: taint``: values that come from a source and reach a sink through variables without a sanitizer in between.

One pass over a Python file gives its def-use edges: a node is a definition of a variable or a sink, an edge says that the value of the first is in
that of the second. Branches keep both definitions, a later definition on the same path replaces the earlier one, and the edges of a sanitizer's
arguments are left out. What the sources reach is then a fixpoint of joins over the edges of all files; it takes a round for each step of the
longest chain of variables. Functions are followed by themselves: parameters bring nothing in, and a call of another function of the
tree passes on what its arguments hold.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schemas import SEVERITIES
from ..scratch import stored
from .rules import Pack, Rule
from .scan import DIRECTIVE, directive_suppresses, noqa_suppresses, with_context
from .syntax import in_frames

EDGE = "file_path string, rule int, src int, dst int, sink boolean, line int, col_start int, col_end int"
#: The node that all sources stand for.
SOURCE = 0


@dataclass
class _Value:
    """What an expression may hold: definitions, and whether a source is in it."""

    nodes: set[int] = field(default_factory=set)
    source: bool = False

    def add(self, other: _Value) -> None:
        self.nodes |= other.nodes
        self.source |= other.source


def dotted(node: ast.AST) -> str:
    """``a.b.c`` of names and attributes; calls and subscripts on the way are left out."""
    parts = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Subscript):
            node = node.value
        else:
            return ".".join([*([node.id] if isinstance(node, ast.Name) else []), *reversed(parts)])


class Flow:
    """The edges of one file for one rule. ``env`` maps a variable to the definitions that may be in it."""

    def __init__(self, sources: list[re.Pattern], sinks: list[re.Pattern], sanitizers: list[re.Pattern]):
        self.sources, self.sinks, self.sanitizers = sources, sinks, sanitizers
        self.numbers: dict[int, int] = {}
        self.edges: dict[tuple[int, int], tuple] = {}

    def number(self, node: ast.AST) -> int:
        return self.numbers.setdefault(id(node), len(self.numbers) + 1)

    def define(self, node: ast.AST, value: _Value) -> int:
        me = self.number(node)
        self._edges(value, me, (False, 0, 0, 0))
        return me

    def _edges(self, value: _Value, me: int, at: tuple) -> None:
        for n in value.nodes:
            self.edges[n, me] = at
        if value.source:
            self.edges[SOURCE, me] = at

    def _hit(self, patterns: list[re.Pattern], name: str) -> bool:
        return bool(name) and any(p.search(name) for p in patterns)

    # expressions

    def value(self, node: ast.AST | None, env: dict) -> _Value:
        out = _Value()
        if node is None:
            return out
        if isinstance(node, ast.Name):
            out.nodes |= env.get(node.id, set())
            out.source = node.id not in env and self._hit(self.sources, node.id)
        elif isinstance(node, ast.Call):
            name = dotted(node.func)
            given = _Value()
            for x in [*node.args, *(k.value for k in node.keywords)]:
                given.add(self.value(x, env))
            if self._hit(self.sinks, name):
                self._edges(given, self.number(node), (True, node.lineno, node.col_offset + 1, node.end_col_offset + 1))
            if self._hit(self.sanitizers, name):
                return out
            out.add(given)
            if isinstance(node.func, ast.Attribute):
                out.add(self.value(node.func.value, env))  # a method's result holds what its object does
            elif not isinstance(node.func, ast.Name):
                out.add(self.value(node.func, env))
            out.source |= self._hit(self.sources, name)
        elif isinstance(node, ast.Attribute | ast.Subscript):
            out.add(self.value(node.value, env))
            out.source |= self._hit(self.sources, dotted(node))
            if isinstance(node, ast.Subscript):
                self.value(node.slice, env)
        elif isinstance(node, ast.NamedExpr):
            out.add(self.value(node.value, env))
            env[node.target.id] = {self.define(node, out)}
        elif isinstance(node, ast.Lambda):
            inner = dict(env) | {a.arg: set() for a in node.args.args}
            out.add(self.value(node.body, inner))
        elif isinstance(node, ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp):
            inner = dict(env)
            for g in node.generators:
                self.assign(g.target, g, self.value(g.iter, inner), inner)
                for x in g.ifs:
                    self.value(x, inner)
            for x in (node.key, node.value) if isinstance(node, ast.DictComp) else (node.elt,):
                out.add(self.value(x, inner))
        elif isinstance(node, ast.Compare):
            for x in [node.left, *node.comparators]:
                self.value(x, env)  # a comparison's result holds none of its sides
        elif isinstance(node, ast.IfExp):
            self.value(node.test, env)
            out.add(self.value(node.body, env))
            out.add(self.value(node.orelse, env))
        else:
            for x in ast.iter_child_nodes(node):
                if isinstance(x, ast.expr | ast.FormattedValue | ast.keyword):
                    out.add(self.value(x, env))
        return out

    # statements

    def assign(self, target: ast.AST, at: ast.AST, value: _Value, env: dict) -> None:
        me = self.define(at, value)
        for t in ast.walk(target):
            if isinstance(t, ast.Name) and isinstance(t.ctx, ast.Store):
                env[t.id] = {me}
        base = target
        while isinstance(base, ast.Attribute | ast.Subscript | ast.Starred):
            base = base.value
        if base is not target and isinstance(base, ast.Name):  # a part of a thing: what it held before stays
            env[base.id] = env.get(base.id, set()) | {me}

    @staticmethod
    def either(*ways: dict) -> dict:
        return {k: set().union(*(w.get(k, ()) for w in ways)) for k in {k for w in ways for k in w}}

    def block(self, body: list[ast.stmt], env: dict) -> dict:
        for s in body:
            env = self.statement(s, env)
        return env

    def loop(self, body: list[ast.stmt], env: dict) -> dict:
        """Until the definitions at its start are the same: what a turn defines may be used in the next."""
        while True:
            after = self.either(env, self.block(body, dict(env)))
            if after == env:
                return env
            env = after

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, env: dict) -> None:
        a = node.args
        inner = dict(env) | {x.arg: set() for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]}
        self.block(node.body, inner)

    def statement(self, s: ast.stmt, env: dict) -> dict:
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
            self.function(s, env)
        elif isinstance(s, ast.ClassDef):
            self.block(s.body, dict(env))
        elif isinstance(s, ast.Assign):
            value = self.value(s.value, env)
            for i, t in enumerate(s.targets):
                self.assign(t, s if not i else t, value, env)
        elif isinstance(s, ast.AnnAssign):
            if s.value:
                self.assign(s.target, s, self.value(s.value, env), env)
        elif isinstance(s, ast.AugAssign):
            value = self.value(s.value, env)
            if isinstance(s.target, ast.Name):
                value.nodes |= env.get(s.target.id, set())
            self.assign(s.target, s, value, env)
        elif isinstance(s, ast.Delete):
            for t in s.targets:
                if isinstance(t, ast.Name):
                    env.pop(t.id, None)
        elif isinstance(s, ast.If):
            self.value(s.test, env)
            return self.either(self.block(s.body, dict(env)), self.block(s.orelse, dict(env)))
        elif isinstance(s, ast.For | ast.AsyncFor):
            value = self.value(s.iter, env)
            inner = dict(env)
            self.assign(s.target, s, value, inner)
            return self.block(s.orelse, self.loop(s.body, self.either(env, inner)))
        elif isinstance(s, ast.While):
            self.value(s.test, env)
            return self.block(s.orelse, self.loop(s.body, env))
        elif isinstance(s, ast.With | ast.AsyncWith):
            for item in s.items:
                value = self.value(item.context_expr, env)
                if item.optional_vars is not None:
                    self.assign(item.optional_vars, item, value, env)
            return self.block(s.body, env)
        elif isinstance(s, ast.Try | ast.TryStar):
            done = self.block(s.body, dict(env))
            caught = [self.block(h.body, self.either(env, done)) for h in s.handlers]
            return self.block(s.finalbody, self.either(self.block(s.orelse, done), *caught))
        elif isinstance(s, ast.Match):
            value = self.value(s.subject, env)
            ways = [env]
            for c in s.cases:
                inner = dict(env)
                me = self.define(c, value)
                inner |= {n: {me} for p in ast.walk(c.pattern) if (n := getattr(p, "name", None) or getattr(p, "rest", None))}
                self.value(c.guard, inner)
                ways.append(self.block(c.body, inner))
            return self.either(*ways)
        else:
            for x in ast.iter_child_nodes(s):
                if isinstance(x, ast.expr):
                    self.value(x, env)
        return env


def _compiled(patterns: tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(p) for p in patterns]


def taint_rules(packs: list[Pack]) -> list[tuple[int, Pack, Rule]]:
    """The rules of ``mode: taint`` that can be used, with the number of their pack."""
    out = []
    for number, pack in enumerate(packs):
        for rule in pack.rules:
            if rule.mode == "taint" and rule.enabled and rule.sources and rule.sinks:
                try:
                    _compiled((*rule.sources, *rule.sinks, *rule.sanitizers))
                    out.append((number, pack, rule))
                except re.error as e:
                    warnings.warn(f"rule {pack.full_id(rule)}: a pattern is malformed, left out ({e})", stacklevel=2)
    return out


def edges(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """``EDGE`` rows of all Python files, for each rule by its place in the list; ``src`` is ``SOURCE`` where a source is."""
    given = [(r.sources, r.sinks, r.sanitizers) for r in rules]

    def of_file(path: str, content: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(content)
            for i, patterns in enumerate(given):
                flow = Flow(*map(_compiled, patterns))
                flow.block(tree.body, {})
                for (src, dst), at in flow.edges.items():
                    yield path, i, src, dst, *at
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return

    def run(batches):
        yield from in_frames((row for pdf in batches for file in zip(pdf["file_path"], pdf["content"], strict=True) for row in of_file(*file)), EDGE)

    python = files.filter((paths.detect_language(F.col("file_path")) == "python") & F.col("content").isNotNull())
    return python.select("file_path", "content").mapInPandas(run, EDGE)


def reached(flows: DataFrame) -> DataFrame:
    """file_path, rule, dst: all that the sources reach, by joins of the last round's nodes with the edges."""
    at = ["file_path", "rule"]
    new = stored(flows.filter(F.col("src") == SOURCE).select(*at, "dst").distinct())
    out = new
    steps = flows.filter((F.col("src") != SOURCE) & ~F.col("sink"))
    while new.limit(1).count():
        after = steps.join(new.withColumnRenamed("dst", "src"), [*at, "src"]).select(*at, "dst").distinct()
        new = stored(after.join(out, [*at, "dst"], "left_anti"))
        out = stored(out.unionByName(new))
    return out


def scan_flows(files: DataFrame, packs: list[Pack], keyword: str = DIRECTIVE) -> DataFrame | None:
    """Violations of all taint rules, in the columns of ``scan.scan``, where the sink is called; None if there is no such rule."""
    chosen = taint_rules(packs)
    if not chosen:
        return None
    flows = stored(edges(files, [r for _, _, r in chosen]))
    hit = flows.filter("sink").join(reached(flows).withColumnRenamed("dst", "src"), ["file_path", "rule", "src"], "left_semi")
    direct = flows.filter(F.col("sink") & (F.col("src") == SOURCE))
    hits = hit.unionByName(direct).select("file_path", "rule", "line", "col_start", "col_end").distinct()
    texts = with_context(files.select("file_path", "content")).withColumn("lines", F.split("content", text.LINE_BREAK))
    rows = hits.join(texts, "file_path").withColumn("said", F.coalesce(F.get("lines", F.col("line") - 1), F.lit("")))
    out = None
    for i, (number, pack, rule) in enumerate(chosen):
        full = pack.full_id(rule)
        mine = rows.filter((F.col("rule") == i) & ~noqa_suppresses(F.col("said"), full) & ~directive_suppresses(F.col("said"), full, keyword))
        if rule.skip_tests:
            mine = mine.filter(~F.col("in_test_file"))
        if "*" not in rule.languages and "python" not in rule.languages:
            continue
        message = F.replace(F.replace(F.lit(rule.message), F.lit("{file}"), F.col("file_path")), F.lit("{line}"), F.col("line").cast("string"))
        severity = F.when(F.col("in_test_file") & F.lit(SEVERITIES.index(rule.severity) < 2), F.lit("MEDIUM")).otherwise(F.lit(rule.severity))
        mine = mine.select(
            F.lit(full).alias("rule_id"), F.lit(rule.name).alias("rule_name"), severity.alias("severity"), "file_path", F.col("line").alias("line_start"), F.col("line").alias("line_end"), "col_start", "col_end",
            message.alias("message"), F.substring(text.strip(F.col("said")), 1, 200).alias("snippet"), F.lit(rule.fix_hint).cast("string").alias("fix_hint"), F.array(*map(F.lit, rule.references)).cast("array<string>").alias("references"),
            "confidence", "in_test_file", F.struct(F.lit(number).alias("pack"), F.col("file_path").alias("file"), F.lit(pack.rules.index(rule)).alias("rule"), F.col("line").alias("line")).alias("seq"),
        )
        out = mine if out is None else out.unionByName(mine)
    return out
