"""Chunks by syntax: imports, functions, classes and methods of Python and JavaScript files, as handlers of ``chunk_file``.

A scanner tells strings and comments from code and keeps the depth of brackets; blocks follow from indents or braces. It
names what it finds and judges no grammar: of a file that breaks off, the open block reaches its end. What stands between
the blocks is chunked as plain code, so that nothing is lost. A class is a chunk, and its methods are chunks besides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

Piece = tuple[int, int, str, tuple[str, ...], str, str | None]

PY_TOKEN = re.compile(r'("""|\'\'\')(?:\\.|(?!\1).)*(?:\1|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|#[^\n]*|\\\n|[()\[\]{}]|\n', re.DOTALL)
PY_DEF = re.compile(r"(?:async\s+)?def\s+(\w+)|class\s+(\w+)")
JS_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`|[()\[\]{}]|\n|/", re.DOTALL)
#: After one of these, or at the start, a slash begins a pattern and doesn't divide.
JS_BEFORE_PATTERN = re.compile(r"(?:^|[=(,;:!&|?{}\[+\-*%<>~^]|\breturn|\btypeof|\bcase)\s*$")
JS_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
JS_HEAD = re.compile(
    r"(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s*(?P<function>\w+)?\s*\(|class\s+(?P<class>\w+)|(?:const|let|var)\s+(?P<bound>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>))"
)
JS_IMPORT = re.compile(r"import\b(?!\s*\()|export\s+(?:\*|\{[^}]*\})\s*from\b|(?:const|let|var)\s+[\w${},\s:]+=\s*require\s*\(")
JS_METHOD = re.compile(r"(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+|\*\s*)*([#\w$]+)\s*\(")
NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "super", "function"}


@dataclass
class Line:
    """A logical line: what belongs together over line ends, in brackets or strings."""

    first: int
    last: int
    depth: int
    text: str

    @property
    def indent(self) -> int:
        return len(self.text.expandtabs(8)) - len(self.text.expandtabs(8).lstrip())


def _logical(text: str, spans: list[tuple[int, int, int]]) -> list[Line]:
    """spans: begin, end and depth of each logical line. Blank ones go."""
    out, at, number = [], 0, 1
    for start, end, depth in spans:
        number += text.count("\n", at, start)
        body = text[start:end]
        if body.strip():
            lead = len(body) - len(body.lstrip("\n"))
            out.append(Line(number + body[:lead].count("\n"), number + body.rstrip().count("\n"), depth, body[lead:].rstrip()))
        number += body.count("\n")
        at = end
    return out


def python_lines(text: str) -> list[Line]:
    spans, depth, start = [], 0, 0
    for m in PY_TOKEN.finditer(text):
        token = m.group()
        if token in "([{":
            depth += 1
        elif token in ")]}":
            depth = max(0, depth - 1)
        elif token == "\n" and not depth:
            spans.append((start, m.end(), 0))
            start = m.end()
    spans.append((start, len(text), 0))
    return [x for x in _logical(text, spans) if not x.text.lstrip().startswith("#")]


def javascript_lines(text: str) -> list[Line]:
    """Lines with the depth of braces at their begin; a line goes on while a round or square bracket is open. Templates keep
    a stack: what stands in ${} is code again."""
    spans, braces, start, begin = [], 0, 0, 0
    stack: list[str] = []
    at = 0
    while at < len(text):
        if stack and stack[-1] == "`":
            m = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.DOTALL).match(text, at)
            at = m.end()
            if text.startswith("${", at):
                stack.append("${")
                at += 2
            else:
                stack.pop()
                at += 1
            continue
        m = JS_TOKEN.search(text, at)
        if not m:
            break
        token, at = m.group(), m.end()
        if token == "`":
            stack.append("`")
        elif token == "/":
            if JS_BEFORE_PATTERN.search(text, max(0, m.start() - 40), m.start()) and (p := JS_PATTERN.match(text, m.start())):
                at = p.end()
        elif token in "([{":
            stack.append(token)
            braces += token == "{"
        elif token in ")]}":
            if stack:
                braces -= stack.pop() == "{"
        elif token == "\n" and not any(x in "([`" or x == "${" for x in stack):
            spans.append((start, at, begin))
            start, begin = at, braces
    spans.append((start, len(text), begin))
    return [x for x in _logical(text, spans) if not x.text.lstrip().startswith("//")]


def _blocks_python(lines: list[Line], indent: int) -> list[tuple[int, int, str, str]]:
    """(first, last line of the list, kind, name) of the definitions that stand at an indent, decorators included."""
    out, k = [], 0
    while k < len(lines):
        head = k
        while head < len(lines) and lines[head].indent == indent and lines[head].text.lstrip().startswith("@"):
            head += 1
        m = PY_DEF.match(lines[head].text.lstrip()) if head < len(lines) and lines[head].indent == indent else None
        if not m:
            k = max(head, k + 1)
            continue
        end = head + 1
        while end < len(lines) and lines[end].indent > indent:
            end += 1
        out.append((k, end - 1, "class" if m[2] else "function", m[1] or m[2]))
        k = end
    return out


def _blocks_javascript(lines: list[Line], depth: int) -> list[tuple[int, int, str, str]]:
    out, k = [], 0
    while k < len(lines):
        text = lines[k].text.lstrip()
        kind = name = None
        if lines[k].depth == depth:
            if depth == 0 and (m := JS_HEAD.match(text)):
                kind, name = ("class", m["class"]) if m["class"] else ("function", m["function"] or m["bound"] or "default")
            elif depth and (m := JS_METHOD.match(text)) and m[1] not in NO_METHOD and "{" in text:
                kind, name = "function", m[1]
        if kind is None:
            k += 1
            continue
        end = k + 1
        while end < len(lines) and lines[end].depth > depth:
            end += 1
        out.append((k, end - 1, kind, name))  # the line that closes a block begins within it
        k = end
    return out


def _pieces(text: str, lines: list[Line], blocks, imports: list[tuple[int, int]], inner) -> list[Piece]:
    """imports: first and last line of the list of each. inner: the blocks within a class, from its lines."""
    raw = text.split("\n")
    take = lambda a, b: "\n".join(raw[a - 1 : b])
    out: list[Piece] = []
    if imports:
        own = tuple(take(lines[a].first, lines[b].last).strip() for a, b in imports)
        out.append((lines[imports[0][0]].first, lines[imports[-1][1]].last, "\n".join(own), own, "import", "imports"))
    taken = [(lines[a].first, lines[b].last) for a, b in imports]
    for a, b, kind, name in blocks:
        first, last = lines[a].first, lines[b].last
        taken.append((first, last))
        out.append((first, last, take(first, last), (), kind, name))
        if kind == "class":
            for c, d, what, method in inner(lines[a : b + 1]):
                if what == "function":
                    f, t = lines[a + c].first, lines[a + d].last
                    out.append((f, t, take(f, t), (), "method", f"{name}.{method}"))
    at = 1
    rest: list[Piece] = []
    for first, last in [*sorted(taken), (len(raw) + 1, len(raw) + 1)]:
        own = range(at, first)
        body = [n for n in own if raw[n - 1].strip()]
        if body:
            rest.append((body[0], body[-1], take(body[0], body[-1]), (), "generic", None))
        at = max(at, last + 1)
    head, others = out[:1] if imports else [], out[1:] if imports else out
    return head + sorted([*others, *rest], key=lambda p: (p[0], -p[1]))


def python_chunks(text: str) -> list[Piece]:
    """(first, last line, content, imports, kind, name): the import chunk first, then in the order of lines."""
    lines = python_lines(text)
    imports = [(k, k) for k, x in enumerate(lines) if not x.indent and re.match(r"import\s|from\s+[.\w]+\s+import\b", x.text)]
    inside = lambda own: _blocks_python(own, next((x.indent for x in own[1:] if x.indent > own[0].indent), -1))
    return _pieces(text, lines, _blocks_python(lines, 0), imports, inside)


def javascript_chunks(text: str) -> list[Piece]:
    lines = javascript_lines(text)
    heads = [k for k, x in enumerate(lines) if not x.depth and JS_IMPORT.match(x.text.lstrip())]
    imports = [(k, next((n for n in range(k, len(lines) - 1) if not lines[n + 1].depth), len(lines) - 1)) for k in heads]
    return _pieces(text, lines, [b for b in _blocks_javascript(lines, 0) if b[0] not in heads], imports, lambda own: _blocks_javascript(own, 1))


HANDLERS = {".py": python_chunks, **{end: javascript_chunks for end in (".js", ".jsx", ".ts", ".tsx", ".mjs")}}
