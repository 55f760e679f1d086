"""Lexical states of source text: what is a comment or a string, so that braces in them do not count.

``mask`` blanks comments and strings (same length, line ends kept); depths of braces are then those of the code alone. Each language is a
table of openers; the state machine jumps from one opener to the next by a regex, so a file is read once whatever is in it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: A string or comment: what opens it, the pattern of what it holds up to its end. An end that is missing is the end of the file.
LINE_END = r"[^\n]*"


@dataclass(frozen=True)
class Lexis:
    """Openers in the order they are tried, each with the pattern that runs from behind the opener to behind the end."""

    openers: tuple[tuple[str, str], ...]
    templates: bool = False
    nested_comments: bool = False
    heredocs: str | None = None
    regexes: bool = False


_ONE_LINE = {q: rf"(?:\\[\s\S]|[^{q}\\\n])*{q}?" for q in "'\""}
_LINES = {q: rf"(?:\\[\s\S]|[^{q}\\])*(?:{q}|\\?\Z)" for q in "'\"`"}
_BLOCK = (r"/\*", r"(?:[^*]|\*(?!/))*(?:\*/|\Z)")
_SLASHES = (r"//", LINE_END)
_C = (_SLASHES, _BLOCK, ('"', _ONE_LINE['"']), ("'", _ONE_LINE["'"]))
_RAW = (r'"""', r'(?:[^"]|"(?!""))*(?:"""|\Z)')

LEXES: dict[str, Lexis] = {
    ".js": Lexis(_C, templates=True, regexes=True),
    ".java": Lexis((_SLASHES, _BLOCK, _RAW, *_C[2:])),
    ".cs": Lexis((_SLASHES, _BLOCK, _RAW, (r'\$?@\$?"', r'(?:[^"]|"")*(?:"|\Z)'), *_C[2:])),
    ".go": Lexis((*_C, ("`", r"[^`]*(?:`|\Z)"))),
    # a quote in Rust is a character only if one character, or an escape, and a quote follow; otherwise it is a lifetime
    ".rs": Lexis((_SLASHES, (r'b?r(#*)"', ""), ('b?"', _LINES['"']), (r"'(?=\\|.')", r"(?:\\[^']*'|.')")), nested_comments=True),
    ".php": Lexis((_SLASHES, _BLOCK, (r"#(?!\[)", LINE_END), ('"', _LINES['"']), ("'", _LINES["'"])), heredocs=r"<<<[ \t]*(?P<q>['\"]?)(?P<name>\w+)(?P=q)[^\n]*\n"),
    ".rb": Lexis(((r"^=begin\b", r"[\s\S]*?(?:^=end\b[^\n]*|\Z)"), (r"#(?!\{)", LINE_END), ('"', _LINES['"']), ("'", _LINES["'"])), heredocs=r"<<[~-]?(?P<q>['\"]?)(?P<name>[A-Z_]\w*)(?P=q)[^\n]*\n"),
    ".prisma": Lexis((_SLASHES, ('"', _ONE_LINE['"']))),
}
LEXES |= {".jsx": LEXES[".js"], ".ts": LEXES[".js"], ".tsx": LEXES[".js"]}

_BLANK = re.compile(r"[^\n]")
#: Behind these a slash starts a regex literal and does not divide.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new))\s*\Z")
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")


@lru_cache(maxsize=32)
def _machine(suffix: str) -> tuple[re.Pattern, tuple[re.Pattern, ...]]:
    lexis = LEXES[suffix]
    extra = ([r"`|[{}]"] if lexis.templates else []) + ([r"/(?![/*])"] if lexis.regexes else []) + ([r"/\*"] if lexis.nested_comments else []) + ([re.sub(r"\?P<(\w+)>", r"?P<h\1>", lexis.heredocs).replace("(?P=q)", "(?P=hq)")] if lexis.heredocs else [])
    openers = [f"(?P<o{i}>{o.replace('(#*)', '(?P<hashes>#*)')})" for i, (o, _) in enumerate(lexis.openers)]
    return re.compile("|".join([*openers, *(f"(?:{x})" for x in extra)]), re.M), tuple(re.compile(p, re.M) for _, p in lexis.openers)


def _nested_end(content: str, at: int) -> int:
    """Behind a block comment that may hold others; ``at`` is behind its opener."""
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(content, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(content)


def spans(content: str, suffix: str) -> list[tuple[int, int]]:
    """Where comments and strings are, in order; of a template only the parts that are text."""
    if suffix not in LEXES:
        return []
    lexis = LEXES[suffix]
    opener, ends = _machine(suffix)
    out: list[tuple[int, int]] = []
    holes: list[int] = []  # of each template that is open around here: the depth of braces in its hole
    at = 0

    def template(start: int, at: int) -> int:
        """From the text of a template to behind its end, or into its next hole."""
        for m in re.compile(r"\\[\s\S]|`|\$\{").finditer(content, at):
            if m[0] == "`":
                out.append((start, m.end()))
                return m.end()
            if m[0] == "${":
                out.append((start, m.end()))
                holes.append(0)
                return m.end()
        out.append((start, len(content)))
        return len(content)

    while m := opener.search(content, at):
        name = m.lastgroup  # of groups that hold each other the outer one
        if name and name[0] == "o":
            i = int(name[1:])
            if "hashes" in m.re.groupindex and m["hashes"] is not None:
                end = content.find('"' + m["hashes"], m.end())
                at = len(content) if end < 0 else end + 1 + len(m["hashes"])
            else:
                end = ends[i].match(content, m.end())
                at = end.end() if end else m.end()
            out.append((m.start(), at))
        elif "hname" in m.re.groupindex and m["hname"] is not None:
            end = re.compile(rf"^[ \t]*{m['hname']}\b", re.M).search(content, m.end())
            at = end.end() if end else len(content)
            out.append((m.end(), at))
        elif m[0] == "`":
            at = template(m.start(), m.end())
        elif m[0] == "{":
            at = m.end()
            if holes:
                holes[-1] += 1
        elif m[0] == "}":
            at = m.end()
            if holes and holes[-1] == 0:
                holes.pop()
                at = template(m.start(), m.end())
            elif holes:
                holes[-1] -= 1
        elif m[0] == "/*":
            at = _nested_end(content, m.end()) if lexis.nested_comments else m.end()
            out.append((m.start(), at))
        else:  # a slash
            r = _REGEX.match(content, m.start()) if _BEFORE_REGEX.search(content, max(0, m.start() - 40), m.start()) else None
            at = r.end() if r else m.end()
            if r:
                out.append((m.start(), at))
    return out


def mask(content: str, suffix: str) -> str:
    """The content with blanks for comments and strings; line ends stay."""
    out, at = [], 0
    for start, end in spans(content, suffix):
        part = content[start:end]
        out += [content[at:start], _BLANK.sub(" ", part) if "\n" in part else " " * len(part)]
        at = end
    return "".join([*out, content[at:]]) if out else content


def closing(code: str, at: int, pair: str = "{}") -> int:
    """Where the bracket that opens at ``at`` of masked code is closed; the end of the code if it is not."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return len(code)
