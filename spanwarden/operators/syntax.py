"""Syntax trees as a table of nodes, and tree patterns evaluated as joins on it.

``nodes`` gives one row a node: its number in pre-order, that of its parent, the last number below it (so that "inside" is an interval), its
kind, the field it fills in its parent and its place among the siblings. Python is read by the standard parser, JavaScript by brackets of
masked code (functions, classes, methods, calls). A pattern such as ``(function_definition name: (identifier) @fn_name body: (block) @fn_body)`` becomes
one equi-join of (file, parent) a node of the pattern, over rows filtered by kind first; predicates are filters on the captured text.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schemas import SEVERITIES
from ..scratch import stored
from . import lexis
from .rules import Pack, Rule, java_regex
from .scan import DIRECTIVE, directive_suppresses, with_context

NODE = "file_path string, language string, id int, parent int, last int, kind string, field string, place int, n_siblings int, scope int, start int, end int, start_line int, start_col int, end_line int, end_col int"
#: What rules read of a captured node: its text, its line (where that may hold a directive), and the start of the line, stripped.
SAID = "text string, line string, shown string"
CONFIDENCE = 0.9
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # as ``text.strip``

# --- Python ---------------------------------------------------------------------------------------------------------------------

#: The names of a syntax tree's nodes and fields by the standard parser's class and attribute.
PYTHON_KINDS = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Return": "return_statement", "Delete": "delete_statement",
    "Assign": "assignment", "AugAssign": "augmented_assignment", "AnnAssign": "assignment", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "If": "if_statement",
    "With": "with_statement", "AsyncWith": "with_statement", "Match": "match_statement", "Raise": "raise_statement", "Try": "try_statement", "TryStar": "try_statement", "Assert": "assert_statement",
    "Import": "import_statement", "ImportFrom": "import_from_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement", "Expr": "expression_statement", "Pass": "pass_statement",
    "Break": "break_statement", "Continue": "continue_statement", "BoolOp": "boolean_operator", "NamedExpr": "named_expression", "BinOp": "binary_operator", "UnaryOp": "unary_operator", "Lambda": "lambda",
    "IfExp": "conditional_expression", "Dict": "dictionary", "Set": "set", "ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension",
    "GeneratorExp": "generator_expression", "Await": "await", "Yield": "yield", "YieldFrom": "yield", "Compare": "comparison_operator", "Call": "call", "JoinedStr": "string", "Attribute": "attribute",
    "Subscript": "subscript", "Starred": "list_splat", "Name": "identifier", "List": "list", "Tuple": "tuple", "Slice": "slice", "ExceptHandler": "except_clause", "keyword": "keyword_argument",
    "arg": "identifier", "withitem": "with_item", "match_case": "case_clause",
}
PYTHON_FIELDS = {
    "value": "value", "target": "left", "targets": "left", "func": "function", "test": "condition", "iter": "right", "left": "left", "right": "right", "returns": "return_type", "annotation": "type",
    "slice": "subscript", "cause": "cause", "operand": "argument", "optional_vars": "alias", "context_expr": "value",
}
#: Nodes that have no class of their own in the standard parser, and what their children stand in.
MADE_KINDS = ("block", "typed_parameter", "for_in_clause", "parameters", "argument_list", "decorated_definition", "decorator", "string", "integer", "float", "true", "false", "none", "ellipsis", "comment", "ERROR")
MADE_FIELDS = ("name", "body", "parameters", "superclasses", "arguments", "object", "attribute", "definition", "consequence", "alternative", "value")
CONSTANTS = {str: "string", bytes: "string", int: "integer", float: "float", complex: "float", type(None): "none", type(...): "ellipsis"}
JAVASCRIPT_KINDS = (
    "program", "function_declaration", "generator_function_declaration", "function_expression", "class_declaration", "class_body", "method_definition", "arrow_function", "variable_declarator", "call_expression", "new_expression",
    "member_expression", "identifier", "property_identifier", "formal_parameters", "arguments", "statement_block", "string", "template_string", "comment",
)
JAVASCRIPT_FIELDS = ("name", "parameters", "body", "function", "constructor", "arguments", "object", "property", "value")
KINDS = {"python": {*PYTHON_KINDS.values(), *MADE_KINDS}, "javascript": {*JAVASCRIPT_KINDS}}
FIELDS = {"python": {*PYTHON_FIELDS.values(), *MADE_FIELDS}, "javascript": {*JAVASCRIPT_FIELDS}}


@dataclass
class _Tree:
    """A node before it is numbered: where it is in the bytes of the file, and its children."""

    kind: str
    start: int
    end: int
    role: str | None = None
    children: list[_Tree] = field(default_factory=list)


class _Python:
    """The standard parser's tree with the names above."""

    def __init__(self, content: str):
        import ast

        self.ast, self.data = ast, content.encode()
        # a line ends where the parser's does: at a line feed, also behind a carriage return
        self.starts = [0, *(m.end() for m in re.finditer(rb"\r\n?|\n", self.data))]
        self.root = ast.parse(content)

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def span(self, node) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def tree(self) -> _Tree:
        top = _Tree("module", 0, len(self.data))
        top.children = self.body(self.root.body)
        return top

    def body(self, statements) -> list[_Tree]:
        return [self.statement(s) for s in statements]

    def block(self, statements, role: str) -> list[_Tree]:
        inside = self.body(statements)
        return [_Tree("block", inside[0].start, inside[-1].end, role, inside)] if inside else []

    def named(self, node, word: bytes) -> _Tree:
        """The identifier behind ``def`` or ``class``."""
        start, _ = self.span(node)
        m = re.compile(rb"(?:async\s+)?" + word + rb"(?:\s|\\\r?\n)+(\w+|[^\s(:\[]+)").match(self.data, start)
        return _Tree("identifier", m.start(1), m.end(1), "name") if m else _Tree("identifier", start, start, "name")

    def statement(self, node) -> _Tree:
        ast = self.ast
        start, end = self.span(node)
        kind = PYTHON_KINDS.get(type(node).__name__, type(node).__name__.lower())
        out = _Tree(kind, start, end)
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            a = node.args
            given = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
            name = self.named(node, b"def")
            low = self.data.find(b"(", name.end)
            arguments = _Tree("parameters", low, max([low + 2, *(self.span(x)[1] for x in given)]), "parameters", [self.expression(x) for x in given])
            out.children = [name, arguments, *([self.expression(node.returns, "return_type")] if node.returns else []), *self.block(node.body, "body")]
        elif isinstance(node, ast.ClassDef):
            bases = [self.expression(x) for x in [*node.bases, *node.keywords]]
            out.children = [self.named(node, b"class"), *([_Tree("argument_list", bases[0].start, bases[-1].end, "superclasses", bases)] if bases else []), *self.block(node.body, "body")]
        elif isinstance(node, ast.Expr):
            out.children = [self.expression(node.value)]
        elif isinstance(node, ast.Assign | ast.AugAssign | ast.AnnAssign):
            left = node.targets if isinstance(node, ast.Assign) else [node.target]
            out.children = [*(self.expression(x, "left") for x in left), *([self.expression(node.annotation, "type")] if isinstance(node, ast.AnnAssign) else []), *([self.expression(node.value, "right")] if node.value else [])]
            out = _Tree("expression_statement", start, end, None, [out])
        else:
            out.children = self.inside(node)
        if getattr(node, "decorator_list", None):
            marks = [self.expression(d) for d in node.decorator_list]
            marks = [_Tree("decorator", self.data.rfind(b"@", 0, m.start), m.end, None, [m]) for m in marks]
            out.role = "definition"
            out = _Tree("decorated_definition", marks[0].start, out.end, None, [*marks, out])
        return out

    def inside(self, node) -> list[_Tree]:
        ast, out = self.ast, []
        for name, value in ast.iter_fields(node):
            if name in ("body", "orelse", "finalbody") and isinstance(value, list):
                role = ("consequence" if isinstance(node, ast.If) else "body") if name == "body" else "alternative"
                out += self.block(value, role)
            elif name in ("handlers", "cases"):
                for h in value:
                    if hasattr(h, "lineno"):
                        h = _Tree(PYTHON_KINDS[type(h).__name__], *self.span(h), None, self.inside(h))
                    else:
                        held = [*([self.expression(h.guard)] if h.guard else []), *self.block(h.body, "consequence")]
                        h = _Tree("case_clause", held[0].start, held[-1].end, None, held)
                    out.append(h)
            elif isinstance(value, ast.AST):
                out += self.some(value, PYTHON_FIELDS.get(name))
            elif isinstance(value, list):
                for v in value:
                    if isinstance(v, ast.AST):
                        out += self.some(v, PYTHON_FIELDS.get(name))
        return sorted(out, key=lambda t: (t.start, -t.end))

    def some(self, node, role: str | None) -> list[_Tree]:
        if hasattr(node, "lineno"):
            return [self.expression(node, role)]
        if type(node).__name__ in PYTHON_KINDS or isinstance(node, self.ast.comprehension):
            inside = self.inside(node)
            return [_Tree(PYTHON_KINDS.get(type(node).__name__, "for_in_clause"), inside[0].start, inside[-1].end, role, inside)] if inside else []
        return []

    def expression(self, node, role: str | None = None) -> _Tree:
        ast = self.ast
        start, end = self.span(node)
        out = _Tree(PYTHON_KINDS.get(type(node).__name__, type(node).__name__.lower()), start, end, role)
        if isinstance(node, ast.Constant):
            out.kind = str(node.value).lower() if isinstance(node.value, bool) else CONSTANTS.get(type(node.value), "string")
        elif isinstance(node, ast.Attribute):
            low = end - len(node.attr.encode())
            out.children = [self.expression(node.value, "object"), _Tree("identifier", low, end, "attribute")]
        elif isinstance(node, ast.Call):
            called = self.expression(node.func, "function")
            given = sorted((self.expression(x) for x in [*node.args, *node.keywords]), key=lambda t: t.start)
            low = self.data.find(b"(", called.end)
            out.children = [called, _Tree("argument_list", low, end, "arguments", given)]
        elif isinstance(node, ast.keyword):
            value = self.expression(node.value, "value")
            out.children = [*([_Tree("identifier", start, start + len(node.arg.encode()), "name")] if node.arg else []), value]
        elif isinstance(node, ast.arg):
            if node.annotation:
                name = _Tree("identifier", start, start + len(node.arg.encode()))
                out = _Tree("typed_parameter", start, end, role, [name, self.expression(node.annotation, "type")])
        elif not isinstance(node, ast.JoinedStr):
            out.children = self.inside(node)
        return out


# --- JavaScript -------------------------------------------------------------------------------------------------------------------

_NAME = r"[A-Za-z_$][\w$]*"
_HEADS = re.compile(
    rf"(?P<function>\bfunction\b\s*(?P<star>\*?)\s*(?P<fname>{_NAME})?\s*(?P<fparams>\())|(?P<class>\bclass\s+(?P<cname>{_NAME})[^{{;]*(?P<cbody>\{{))"
    rf"|(?P<new>\bnew\s+(?P<nname>{_NAME}(?:\s*\.\s*{_NAME})*)\s*(?P<nargs>\())|(?P<arrow>\b(?:const|let|var)\s+(?P<vname>{_NAME})\s*=\s*(?:async\s*)?(?:(?P<aparams>\()|(?P<aone>{_NAME})\s*=>))"
    rf"|(?P<call>(?P<callee>{_NAME}(?:\s*\.\s*{_NAME})*)\s*(?P<args>\())"
)
#: Words before a bracket that do not call anything.
_NO_CALLS = frozenset("if for while switch catch return typeof function await with super in of do else case void delete throw yield".split())


def _javascript(content: str) -> _Tree:
    """Functions, classes with their methods, arrow functions that a name is given to, calls and strings, nested by their brackets."""
    code, found = lexis.mask(content, ".js"), []
    matched = {}
    stack: list[int] = []
    for m in re.finditer(r"[(){}]", code):
        if m[0] in "({":
            stack.append(m.start())
        elif stack and code[stack[-1]] == {")": "(", "}": "{"}[m[0]]:
            matched[stack.pop()] = m.end()
    end_of = lambda at: matched.get(at, len(code))
    name = lambda m, g, kind, role: _Tree(kind, m.start(g), m.end(g), role)

    def block(at: int, role: str = "body", kind: str = "statement_block"):
        low = re.compile(r"\s*").match(code, at).end()
        return _Tree(kind, low, end_of(low), role) if code[low : low + 1] == "{" else None

    for m in _HEADS.finditer(code):
        if m["function"]:
            low = m.start("fparams")
            body = block(end_of(low))
            kind = "generator_function_declaration" if m["star"] else "function_declaration"
            before = code[max(0, m.start() - 60) : m.start()].rstrip()
            if not m["fname"] or before[-1:] in set("=(,:?[!&|+") or before.endswith("return"):
                kind = "function_expression"
            parts = [*([name(m, "fname", "identifier", "name")] if m["fname"] else []), _Tree("formal_parameters", low, end_of(low), "parameters"), *([body] if body else [])]
            start = m.start() - (len(re.search(r"(?:\basync\s+)?\Z", code[max(0, m.start() - 12) : m.start()])[0]))
            found += [_Tree(kind, start, parts[-1].end), *parts]
        elif m["class"]:
            low = m.start("cbody")
            found += [_Tree("class_declaration", m.start(), end_of(low)), name(m, "cname", "identifier", "name"), _Tree("class_body", low, end_of(low), "body")]
        elif m["new"]:
            low = m.start("nargs")
            found += [_Tree("new_expression", m.start(), end_of(low)), _Tree("identifier", m.start("nname"), m.end("nname"), "constructor"), _Tree("arguments", low, end_of(low), "arguments")]
        elif m["arrow"]:
            low, after = (m.start("aparams"), end_of(m.start("aparams"))) if m["aparams"] else (m.start("aone"), m.end("aone"))
            arrow = re.compile(r"\s*=>").match(code, after)
            if arrow:
                body = block(arrow.end())
                end = body.end if body else re.compile(r"[^;\n]*").match(code, arrow.end()).end()
                given = _Tree("formal_parameters", low, after, "parameters") if m["aparams"] else _Tree("identifier", low, after, "parameters")
                found += [_Tree("variable_declarator", m.start("vname"), end), name(m, "vname", "identifier", "name"), _Tree("arrow_function", low, end, "value"), given, *([body] if body else [])]
        elif m["callee"].split(".")[-1].strip() not in _NO_CALLS:
            low, high = m.start("args"), end_of(m.start("args"))
            body = block(high)
            if body and "." not in m["callee"]:  # a name, brackets and a block: a method
                found += [_Tree("method_definition", m.start("callee"), body.end), name(m, "callee", "property_identifier", "name"), _Tree("formal_parameters", low, high, "parameters"), body]
                continue
            found += [_Tree("call_expression", m.start("callee"), high), _Tree("arguments", low, high, "arguments")]
            dot = m["callee"].rfind(".")
            if dot < 0:
                found.append(name(m, "callee", "identifier", "function"))
            else:
                last = re.compile(r"\s*").match(code, m.start("callee") + dot + 1).end()
                found += [_Tree("member_expression", m.start("callee"), m.end("callee"), "function"), _Tree("identifier", m.start("callee"), m.start("callee") + len(m["callee"][:dot].rstrip()), "object"), _Tree("property_identifier", last, m.end("callee"), "property")]
    for start, end in lexis.spans(content, ".js"):
        kind = "comment" if content.startswith(("//", "/*"), start) else "template_string" if content[start] in "`}" else "string"
        found.append(_Tree(kind, start, end))
    top = _Tree("program", 0, len(content))
    open_ = [top]
    for t in sorted(found, key=lambda t: (t.start, -t.end)):  # stable: a node comes before its first child of the same span
        while t.start >= open_[-1].end and len(open_) > 1:
            open_.pop()
        open_[-1].children.append(t)
        open_.append(t)
    if not content.isascii():
        place = [0]
        for c in content:
            place.append(place[-1] + len(c.encode("utf-8", "surrogatepass")))

        left = [top]
        while left:
            t = left.pop()
            t.start, t.end = place[t.start], place[t.end]
            left += t.children
    return top


# --- the table of nodes --------------------------------------------------------------------------------------------------------------

_SCOPES = frozenset(("function_definition", "function_declaration", "generator_function_declaration", "function_expression", "method_definition", "arrow_function"))


def _rows(path: str, language: str, content: str) -> Iterator[tuple]:
    """The nodes of a file in pre-order. A file that cannot be parsed has the one node ERROR."""
    data = content.encode("utf-8", "surrogatepass")
    try:
        top = _Python(content).tree() if language == "python" else _javascript(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        top = _Tree("ERROR", 0, len(data))
    breaks = [0, *(m.end() for m in re.finditer(rb"\n", data))]
    from bisect import bisect_right

    def place(at: int) -> tuple[int, int]:
        line = bisect_right(breaks, at)
        return line, at - breaks[line - 1] + 1

    out: list[list] = []
    stack = [(top, -1, 0, 1, -1, False)]
    while stack:
        t, parent, nth, of, scope, done = stack.pop()
        if done:
            out[parent][4] = len(out) - 1
            continue
        me = len(out)
        out.append([path, language, me, parent, me, t.kind, t.role, nth, of, scope, t.start, t.end, *place(t.start), *place(max(t.start, t.end))])
        stack.append((t, me, 0, 0, 0, True))
        inner = me if t.kind in _SCOPES else scope
        stack += [(c, me, i, len(t.children), inner, False) for i, c in reversed([*enumerate(t.children)])]
    yield from map(tuple, out)


def in_frames(rows: Iterator[tuple], schema: str, size: int = 50_000) -> Iterator[pd.DataFrame]:
    """Rows in frames of a bounded size, with the integers of a schema."""
    fields = [c.split(" ") for c in schema.split(", ")]
    numbers = {name: "int32" for name, kind in fields if kind == "int"}
    while held := list(islice(rows, size)):
        yield pd.DataFrame(held, columns=[name for name, _ in fields]).astype(numbers)


def nodes(files: DataFrame) -> DataFrame:
    """``NODE`` rows of all Python and JavaScript files. ``scope`` is the node of the function around, -1 at the top of a file; columns and bytes count
    in UTF-8, lines and columns from 1."""

    def run(batches):
        yield from in_frames((row for pdf in batches for file in zip(pdf["file_path"], pdf["language"], pdf["content"], strict=True) for row in _rows(*file)), NODE)

    some = files.select("file_path", paths.detect_language(F.col("file_path")).alias("language"), "content")
    return some.filter(F.col("language").isin(*KINDS) & F.col("content").isNotNull()).mapInPandas(run, NODE)


#: For each language (kind or None, field or None, whether its text is read, whether its line is) of the nodes that patterns speak of.
Wanted = dict[str, set[tuple[str | None, str | None, bool, bool]]]


def _said_rows(path: str, language: str, content: str, wanted: Wanted, keyword: str) -> Iterator[tuple]:
    """The rows of ``_rows`` that patterns speak of, with what rules read of them (``SAID``)."""
    data, lines, use, told = content.encode("utf-8", "surrogatepass"), None, {}, {}
    for row in _rows(path, language, content):
        kind, role = row[5:7]
        if (kind, role) not in use:
            fit = [w for w in wanted.get(language, ()) if w[0] in (None, kind) and w[1] in (None, role)]
            use[kind, role] = (any(w[2] for w in fit), any(w[3] for w in fit)) if fit else None
        if use[kind, role] is None:
            continue
        has_text, has_line = use[kind, role]
        if has_line and row[12] not in told:
            lines = re.split(text.LINE_BREAK, content) if lines is None else lines
            line = lines[row[12] - 1] if row[12] <= len(lines) else ""
            told[row[12]] = (line if re.search(re.escape(keyword), line, re.I) else "", line.strip(_WHITE)[:200])
        yield (*row, data[row[10] : row[11]].decode("utf-8", "replace") if has_text else None, *(told[row[12]] if has_line else (None, None)))


def said_nodes(files: DataFrame, wanted: Wanted, keyword: str) -> DataFrame:
    """``NODE`` and ``SAID`` rows of the nodes that patterns speak of: rules need no more of the files."""

    def run(batches):
        yield from in_frames((row for pdf in batches for file in zip(pdf["file_path"], pdf["language"], pdf["content"], strict=True) for row in _said_rows(*file, wanted, keyword)), f"{NODE}, {SAID}")

    some = files.select("file_path", paths.detect_language(F.col("file_path")).alias("language"), "content")
    return some.filter(F.col("language").isin(*wanted) & F.col("content").isNotNull()).mapInPandas(run, f"{NODE}, {SAID}")


# --- patterns ---------------------------------------------------------------------------------------------------------------------------


class QueryError(ValueError):
    """A pattern that cannot be used, said in words for its author."""


@dataclass(frozen=True)
class Pattern:
    """One node: kind (None: any), role (the field it fills), captures, children; ``first``/``last``/``next``: anchored to the start, the end or the
    sibling before; ``without``: fields that it must not have; ``many``: a quantifier."""

    kind: str | None
    role: str | None = None
    captures: tuple[str, ...] = ()
    children: tuple[Pattern, ...] = ()
    next: bool = False
    last: bool = False
    without: tuple[str, ...] = ()
    many: str = ""


_TOKEN = re.compile(r"""\s+|;[^\n]*|(?P<string>"(?:\\.|[^"\\])*")|(?P<punct>[()\[\]])|(?P<pred>#[\w-]+[?!])|(?P<capture>@[\w.-]+)|(?P<field>\w+:)|(?P<not>!\w+)|(?P<many>[*+?])|(?P<anchor>\.)|(?P<name>\w+)""")
PREDICATES = ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?")


def read_query(query: str, language: str) -> tuple[list[Pattern], list[tuple[str, ...]]]:
    """The alternatives of a query (each without a choice left) and its predicates."""
    tokens, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise QueryError(f"{query[at : at + 12]!r} is not understood")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    place, predicates = 0, []

    def peek(k: int = 0):
        return tokens[place + k] if place + k < len(tokens) else ("end", "")

    def take(kind: str | None = None, value: str | None = None):
        nonlocal place
        got = peek()
        if (kind and got[0] != kind) or (value and got[1] != value):
            raise QueryError(f"{value or kind} is expected, not {got[1] or 'the end'!r}")
        place += 1
        return got[1]

    def alternatives() -> list[Pattern]:
        """One item with what follows it: quantifier and captures."""
        role = take("field")[:-1] if peek()[0] == "field" else None
        if role and role not in FIELDS[language]:
            raise QueryError(f"no node has a field {role!r}")
        if peek() == ("punct", "["):
            take()
            out = []
            while peek() != ("punct", "]"):
                out += alternatives()
            take()
        elif peek() == ("name", "_"):
            take()
            out = [Pattern(None)]
        else:
            out = node()
        many = take() if peek()[0] == "many" else ""
        names = []
        while peek()[0] == "capture":
            names.append(take()[1:])
        return [replace(p, role=role or p.role, captures=p.captures + tuple(names), many=many or p.many) for p in out]

    def node() -> list[Pattern]:
        take("punct", "(")
        if peek()[0] == "punct" and peek()[1] in "([":  # a group: one item with predicates
            out = alternatives()
            while peek()[1] == "(" and peek(1)[0] == "pred":
                predicate()
            take("punct", ")")
            return out
        kind = take("name")
        if kind != "_" and kind not in KINDS[language]:
            raise QueryError(f"no node is a {kind!r}")
        sets, without, anchored, last = [[]], [], False, False
        while peek() != ("punct", ")"):
            if peek()[0] == "anchor":
                take()
                anchored = True
            elif peek()[0] == "not":
                without.append(take()[1:])
                if without[-1] not in FIELDS[language]:
                    raise QueryError(f"no node has a field {without[-1]!r}")
            elif peek()[1] == "(" and peek(1)[0] == "pred":
                predicate()
            elif peek()[0] == "end":
                raise QueryError("a bracket is not closed")
            else:
                some = [replace(p, next=anchored) for p in alternatives()]
                sets = [[*s, p] for s in sets for p in some]
                anchored = False
        last = anchored
        take("punct", ")")
        return [Pattern(None if kind == "_" else kind, children=tuple(s), without=tuple(without), last=last) for s in sets]

    def predicate() -> None:
        take("punct", "(")
        name, given = take("pred"), []
        if name not in PREDICATES:
            raise QueryError(f"{name} is none of {', '.join(PREDICATES)}")
        while peek() != ("punct", ")"):
            kind, said = peek()
            if kind not in ("capture", "string", "name"):
                raise QueryError(f"{said!r} cannot stand in a predicate")
            take()
            given.append(re.sub(r"\\(.)", r"\1", said[1:-1]) if kind == "string" else said)
        take("punct", ")")
        if len(given) < 2 or not given[0].startswith("@"):
            raise QueryError(f"{name} needs a capture and a value")
        predicates.append((name, *given))

    out: list[Pattern] = []
    while peek()[0] != "end":
        if peek()[1] == "(" and peek(1)[0] == "pred":
            predicate()
        else:
            out += alternatives()
    if not out:
        raise QueryError("it holds no pattern")
    for p in out:
        names = captured(p)
        if not names:
            raise QueryError("it captures nothing")
        for q in predicates:
            for word in q[1:]:
                if word.startswith("@") and word[1:] not in {n for x in out for n in captured(x)}:
                    raise QueryError(f"{word} is not captured")
    return out, predicates


def captured(p: Pattern) -> list[str]:
    return [*p.captures, *(n for c in p.children for n in captured(c))]


_KEPT = ("id", "last", "place", "n_siblings", "start", "end", "start_line", "start_col", "end_line", "end_col", "text", "line", "shown")


def matches(table: DataFrame, pattern: Pattern, language: str) -> DataFrame:
    """file_path and one struct for each capture: the nodes of each match of one alternative."""
    count = 0

    def alias(p: Pattern, root: bool) -> DataFrame:
        nonlocal count
        rows = table.filter(F.col("language") == language)
        if p.kind:
            rows = rows.filter(F.col("kind") == p.kind)
        else:
            rows = rows.filter(F.col("kind") != "ERROR")
        if p.role:
            rows = rows.filter(F.col("field") == p.role)
        node = F.struct(*_KEPT).alias(f"n{count}")
        count += 1
        return rows.select("file_path", *([] if root else [F.col("parent").alias("up")]), node)

    def grow(rows: DataFrame, p: Pattern, me: str) -> DataFrame:
        for field_ in p.without:
            there = table.filter((F.col("language") == language) & (F.col("field") == field_)).select(F.col("file_path").alias("f"), F.col("parent").alias("up"))
            rows = rows.join(there, (rows["file_path"] == there["f"]) & (F.col(f"{me}.id") == there["up"]), "left_anti")
        before = None
        for c in p.children:
            name = f"n{count}"
            kids = alias(c, False).withColumnRenamed("file_path", "f")
            on = (F.col("file_path") == F.col("f")) & (F.col(f"{me}.id") == F.col("up"))
            if before:
                on = on & (F.col(f"{name}.place") == F.col(f"{before}.place") + 1 if c.next else F.col(f"{name}.place") > F.col(f"{before}.place"))
            elif c.next:
                on = on & (F.col(f"{name}.place") == 0)
            if c.many:  # the first of those in a row; none at all will do for ? and *
                others = [k for k in rows.columns]
                joined = rows.join(kids, on, "inner" if c.many == "+" else "left")
                rows = joined.groupBy(*others).agg(F.min(F.col(name)).alias(name))
                if c.children:
                    raise QueryError("a node that is repeated cannot have children in a pattern")
            else:
                rows = grow(rows.join(kids, on).drop("f", "up"), c, name)
            names.append((c, name))
            before = name
        if p.last and before:
            rows = rows.filter(F.col(f"{before}.place") == F.col(f"{before}.n_siblings") - 1)
        return rows

    names: list[tuple[Pattern, str]] = []
    top = alias(pattern, True)
    rows = grow(top, pattern, "n0")
    columns = {c: name for p, name in [(pattern, "n0"), *names] for c in p.captures}
    return rows.select("file_path", *[F.col(name).alias(f"@{c}") for c, name in columns.items()])


def node_text(capture: str) -> Column:
    """The text of a captured node."""
    return F.col(f"`@{capture}`")["text"]


def _wanted(pattern: Pattern, read: set[str]) -> Iterator[tuple[str | None, str | None, bool, bool]]:
    """What ``Wanted`` has for a pattern, given the captures whose texts are read."""
    yield pattern.kind, pattern.role, bool(read & {*pattern.captures}), bool(pattern.captures)
    yield from ((None, field_, False, False) for field_ in pattern.without)
    for c in pattern.children:
        yield from _wanted(c, read)


def _holds(predicate: tuple[str, ...], captures: list[str]) -> Column:
    name, what, *values = predicate
    if what[1:] not in captures:
        return F.lit(True)
    said = node_text(what[1:])
    value = [node_text(v[1:]) if v.startswith("@") else F.lit(v) for v in values]
    if name in ("#eq?", "#not-eq?"):
        out = said == value[0]
    elif name == "#any-of?":
        out = said.isin(*values)
    else:
        out = said.rlike(java_regex(values[0])[5:])
    return F.coalesce(~out if name.startswith("#not") else out, F.lit(False))


def scan_trees(files: DataFrame, packs: list[Pack], keyword: str = DIRECTIVE) -> DataFrame | None:
    """Violations of all rules of type ``ast``, in the columns of ``scan.scan``; None if no rule can be used.

    A violation stands where ``@fn_name`` is, or else the query's first capture. ``name_regex`` must match the name; a body (``@fn_body``) that
    ``must_not_contain`` matches is none. Queries that cannot be read are warned of and left out, as are languages without a tree.
    """
    chosen: list[tuple[int, int, Pack, Rule, str, list[Pattern], list]] = []
    for number, pack in enumerate(packs):
        patterns = sum(r.type == "pattern" for r in pack.rules)
        for i, rule in enumerate(r for r in pack.rules if r.type == "ast"):
            languages = [k for k in KINDS if "*" in rule.languages or k in rule.languages] if rule.enabled else []
            for language in languages:
                try:
                    for p in filter(None, (rule.name_regex, rule.must_not_contain)):
                        re.compile(p)
                    chosen.append((number, patterns + i, pack, rule, language, *read_query(rule.query, language)))
                except (QueryError, re.error) as e:
                    warnings.warn(f"rule {pack.full_id(rule)}: invalid query for {language}, left out ({e})", stacklevel=2)
    if not chosen:
        return None
    wanted: Wanted = {}
    for _, _, _, _, language, patterns, predicates in chosen:
        read = {"fn_name", "fn_body", *(v[1:] for p in predicates for v in p[1:] if v.startswith("@"))}
        wanted.setdefault(language, set()).update(w for p in patterns for w in _wanted(p, read))
    table, out = stored(said_nodes(files, wanted, keyword)), None
    for number, order, pack, rule, language, patterns, predicates in chosen:
        for pattern in patterns:
            names = list(dict.fromkeys(captured(pattern)))
            rows = with_context(matches(table, pattern, language))
            for p in predicates:
                rows = rows.filter(_holds(p, names))
            if rule.name_regex and "fn_name" in names:
                rows = rows.filter(node_text("fn_name").rlike(java_regex(rule.name_regex)[5:]))
            if rule.must_not_contain and "fn_body" in names:
                rows = rows.filter(~F.coalesce(node_text("fn_body").rlike(java_regex(rule.must_not_contain)[5:]), F.lit(False)))
            if rule.skip_tests:
                rows = rows.filter(~F.col("in_test_file"))
            at = F.coalesce(*[F.col(f"`@{n}`") for n in (["fn_name"] if "fn_name" in names else names)])
            rows = rows.select("file_path", "in_test_file", "confidence", at.alias("at")).filter(F.col("at").isNotNull())
            full = pack.full_id(rule)
            rows = rows.filter(~directive_suppresses(F.col("at.line"), full, keyword))
            message = F.replace(F.replace(F.lit(rule.message), F.lit("{file}"), F.col("file_path")), F.lit("{line}"), F.col("at.start_line").cast("string"))
            severity = F.when(F.col("in_test_file") & F.lit(SEVERITIES.index(rule.severity) < 2), F.lit("MEDIUM")).otherwise(F.lit(rule.severity))
            rows = rows.select(
                F.lit(full).alias("rule_id"), F.lit(rule.name).alias("rule_name"), severity.alias("severity"), "file_path", F.col("at.start_line").alias("line_start"), F.col("at.end_line").alias("line_end"),
                F.col("at.start_col").alias("col_start"), F.col("at.end_col").alias("col_end"), message.alias("message"), F.col("at.shown").alias("snippet"), F.lit(rule.fix_hint).cast("string").alias("fix_hint"),
                F.array(*map(F.lit, rule.references)).cast("array<string>").alias("references"), F.when(F.col("confidence") == 0.85, F.lit(CONFIDENCE)).otherwise(F.col("confidence")).alias("confidence"), "in_test_file",
                F.struct(F.lit(number).alias("pack"), F.col("file_path").alias("file"), F.lit(order).alias("rule"), F.col("at.start_line").alias("line")).alias("seq"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out
