"""Calls and functions of Python and JavaScript sources, and whether a place is in a string."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from lodestone.functions.javacode import NO_CALLS, Java, parts

_TEMPLATE = re.compile(r"`(?:[^`\\]|\\.)*`", re.S)
_NAMED = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:\?\.)?\(")
_NO_CALLS = NO_CALLS | frozenset("function typeof await yield delete void of in import export async default".split())

# String literals by language; others read as Java's.
STRINGS = {
    "java": (r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'"),
    "python": (r'""".*?"""', r"'''.*?'''", r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'"),
    "javascript": (r"`(?:[^`\\]|\\.)*`", r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'"),
}


def in_string(content: str, at: int, language: str) -> bool:
    """Whether a place is inside a string literal, its first character not counted."""
    return any(m.start() < at < m.end() for p in STRINGS.get(language, STRINGS["java"]) for m in re.finditer(p, content, re.S))


class Script(Java):
    """One JavaScript or TypeScript file; templates are literals."""

    def __init__(self, text: str):
        super().__init__(_TEMPLATE.sub(lambda m: '"' + re.sub(r'[^\n]', "_", m[0][1:-1]) + '"', text))
        self.text = text

    def script_calls(self) -> Iterator[tuple[str | None, int, list[str], str]]:
        """(function, line, arguments, text) of calls, those that enclose others first; function: names and dots, null for anything else."""
        out, closes = [], self._brackets[0]
        for m in _NAMED.finditer(self.code):
            at, opening = m.start(), m.end() - 1
            if m[1] in _NO_CALLS or opening not in closes:
                continue
            start, plain = self._chain(at)
            closing = closes[opening]
            before = self.code[max(0, start - 40) : start].rstrip()
            defined = re.match(r"\s*(?::\s*[\w<>\[\]| ]+)?\s*(?:\{|=>)", self.code[closing + 1 : closing + 80])
            if re.search(r"\bfunction\s*\*?$", before) or (defined and start == at) or (plain and re.search(r"\bnew$", before)):
                continue
            if re.search(r"\bnew$", before):
                start = self.code.rfind("new", 0, start)
            callee = self.text[start:opening].rstrip().removesuffix("?.")
            name = re.sub(r"\s+", "", callee) if re.fullmatch(r"[\w$]+(?:\s*\??\.\s*[\w$]+)*", callee) else None
            arguments = parts(self.code[opening + 1 : closing], self.text[opening + 1 : closing])
            out.append((start, -closing, (name, self.line_of(start), arguments, self.text[start : closing + 1])))
        return (x[2] for x in sorted(out, key=lambda x: x[:2]))


def script_calls(content: str) -> Iterator[tuple[str | None, int, list[str], str]]:
    return Script(content).script_calls()


def python_calls(content: str) -> Iterator[tuple[str | None, int, list[str], str]]:
    """The same of a Python file; nothing if it cannot be parsed."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return
    segment = lambda node: ast.get_source_segment(content, node) or ""
    for node in sorted((n for n in ast.walk(tree) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset, -n.end_lineno, -n.end_col_offset)):
        name = segment(node.func)
        given = [*(segment(a) for a in node.args), *(f"{k.arg}={segment(k.value)}" if k.arg else f"**{segment(k.value)}" for k in node.keywords)]
        yield (name if re.fullmatch(r"[\w.]+", name) else None), node.lineno, given, segment(node)


def python_functions(content: str) -> Iterator[tuple[str, int, int, list[str]]]:
    """(name, first line, last line, parameters) of a Python file's functions, in order."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return
    for node in sorted((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), key=lambda n: (n.lineno, n.col_offset)):
        a = node.args
        names = [x.arg for x in (*a.posonlyargs, *a.args)] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
        yield node.name, node.lineno, node.end_lineno, names
