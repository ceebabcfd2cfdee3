"""What Java source says, read without a compiler: types, methods, calls and assigned values.

Comments and the insides of literals are blanked first, so that brackets and
separators are code; every place is a place of the original text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cached_property

_LITERAL = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|""".*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?', re.S)
_ANNOTATION = r"@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?"
_TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_EXTENDS = re.compile(r"\bextends\s+(\w+)(?![\w.<])")
_IMPLEMENTS = re.compile(r"\bimplements\s+(.*)$", re.S)
_MODIFIERS = re.compile(rf"\s*(?:(?:{_ANNOTATION}|public|private|protected|static|final|abstract|synchronized|native|strictfp|default|sealed)(?![\w.])\s*)*")
_ARGUMENTS = r"<(?:[^<>(){};=]|<(?:[^<>(){};=]|<[^<>(){};=]*>)*>)*>"
_HEADER = re.compile(rf"(?:{_ARGUMENTS}\s*)?(?:([\w.]+(?:\s*{_ARGUMENTS})?(?:\s*\[\s*\])*)\s+)?(\w+)\s*(\()")
_NAMED = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")
_ASSIGNED = re.compile(r"([\w.$\[\]]+)\s*(?:[-+*/%&|^]|<<|>>>?)?=(?![=])")
#: Words before a parenthesis that are no calls, and words that may stand before a call.
NO_CALLS = frozenset("if for while switch catch synchronized return assert throw new super this else do try case".split())
_OPEN, _CLOSE = "([{", ")]}"
#: A member's header is looked at up to this length.
_HEADER_CHARS = 8000


@dataclass
class Method:
    name: str
    owner: str
    start: int
    end: int
    parameters: list[str]
    annotations: list[str]
    return_type: str | None
    static: bool = False
    abstract: bool = False


@dataclass
class Type:
    name: str
    kind: str
    start: int
    end: int = -1
    extends: str | None = None
    implements: list[str] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)


@dataclass(frozen=True)
class Call:
    name: str
    receiver: str | None
    arguments: tuple[str, ...]
    start: int
    end: int
    text: str


def blanked(text: str) -> str:
    """The text with comments as blanks and literals' insides as underscores; line feeds stay."""

    def blank(m: re.Match) -> str:
        found = m[0]
        if found[0] == "/":
            return re.sub(r"[^\n]", " ", found)
        return found[0] + re.sub(r"[^\n]", "_", found[1:-1]) + found[-1] if len(found) > 1 else "_"

    return _LITERAL.sub(blank, text)


def parts(code: str, text: str | None = None) -> list[str]:
    """Code between commas that no bracket encloses, as it stands in text; blank parts are left out."""
    out, depth, at = [], 0, 0
    text = code if text is None else text
    for i, c in enumerate(code):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [x for x in (*out, text[at:].strip()) if x]


class Java:
    """One source file."""

    def __init__(self, text: str):
        self.text, self.code = text, blanked(text)

    @cached_property
    def _feeds(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    def line_of(self, at: int) -> int:
        return bisect_right(self._feeds, at - 1) + 1

    @cached_property
    def _brackets(self) -> tuple[dict[int, int], dict[int, int]]:
        """Closing place of each opening one, and the other way round."""
        closes, opens, stack = {}, {}, []
        for m in re.finditer(r"[(){}\[\]]", self.code):
            c = m[0]
            if c in _OPEN:
                stack.append((c, m.start()))
            elif stack and _OPEN.index(stack[-1][0]) == _CLOSE.index(c):
                at = stack.pop()[1]
                closes[at], opens[m.start()] = m.start(), at
        return closes, opens

    @cached_property
    def _read(self) -> tuple[list[Type], set[int], list[tuple[int, bool]]]:
        """Types in the order of their beginnings, places of members' names, and from which place on code is directly in a type."""
        types: list[Type] = []
        declared: set[int] = set()
        marks: list[tuple[int, bool]] = [(0, False)]
        stack: list[list] = [[None, 0, None]]  # type or None, where the current member begins, method that the scope is the body of
        closes, round_ = self._brackets[0], 0
        skip_to = -1
        for m in re.finditer(r"[({};]", self.code):
            at, c = m.start(), m[0]
            if at < skip_to:
                continue
            scope = stack[-1]
            if c == "(":
                if scope[0] and at in closes:  # parameters or arguments of a member: nothing in them is a member
                    inner = self.code.find("{", at, closes[at])
                    if inner < 0:
                        skip_to = closes[at]
                continue
            if c == "}":
                if len(stack) > 1:
                    ended = stack.pop()
                    if ended[2]:
                        ended[2].end = at
                    elif ended[0]:
                        ended[0].end = at
                    stack[-1][1] = at + 1
                    marks.append((at + 1, stack[-1][0] is not None))
                continue
            header = self.code[scope[1] : at]
            if c == ";":
                if scope[0]:
                    self._member(scope[0], scope[1], header, declared, at, True)
                scope[1] = at + 1
                continue
            found = _TYPE.search(header)
            if found and (not scope[0] or not self._looks_like_member(header[: found.start()])):
                kind, name = found[1], found[2]
                extends = _EXTENDS.search(header, found.end())
                implements = _IMPLEMENTS.search(header, found.end())
                names = re.findall(r"(?:^|,)\s*(\w+)(?![\w.])", re.sub(r"<[^<>]*>", "", implements[1])) if implements else []
                begin = scope[1] + len(header) - len(header.lstrip())
                one = Type(name, kind, begin, extends=extends[1] if extends else None, implements=names)
                types.append(one)
                stack.append([one, at + 1, None])
                marks.append((at + 1, True))
            else:
                method = self._member(scope[0], scope[1], header, declared, at, False) if scope[0] else None
                stack.append([None, at + 1, method])
                marks.append((at + 1, False))
        return types, declared, marks

    @staticmethod
    def _looks_like_member(before: str) -> bool:
        return "(" in before and "@" not in before

    def _member(self, owner: Type, begin: int, header: str, declared: set[int], end: int, abstract: bool) -> Method | None:
        """The method that a header in a type declares; names of methods and constructors are noted."""
        if "(" not in header or len(header) > _HEADER_CHARS:
            return None
        modifiers = _MODIFIERS.match(header)
        found = _HEADER.match(header, modifiers.end())
        if not found or found[2] in NO_CALLS:
            return None
        opening = begin + found.start(3)
        closing = self._brackets[0].get(opening)
        if closing is None or not re.fullmatch(r"\s*(?:\[\s*\]\s*)*(?:throws\s[\w.,\s@]+)?", self.code[closing + 1 : end]):
            return None
        declared.add(begin + found.start(2))
        if not found[1] or found[1] in NO_CALLS:
            return None  # a constructor
        start = begin + len(header) - len(header.lstrip())
        given = [p for p in parts(re.sub(r"<[^<>]*>", lambda m: "_" * len(m[0]), self.code[opening + 1 : closing]), self.text[opening + 1 : closing]) if "..." not in p]
        marks = [self.text[begin + m.start() : begin + m.end()] for m in re.finditer(_ANNOTATION, modifiers[0])]
        words = set(re.sub(_ANNOTATION, " ", modifiers[0]).split())
        method = Method(found[2], owner.name, start, end, given, marks, found[1], "static" in words, "abstract" in words or abstract)
        owner.methods.append(method)
        return method

    def types(self) -> list[Type]:
        return self._read[0]

    def classes(self) -> list[Type]:
        return [t for t in self._read[0] if t.kind == "class"]

    def in_type(self, at: int) -> bool:
        """Whether a place is directly in a type and in no body or initializer."""
        marks = self._read[2]
        return marks[bisect_right(marks, (at, True)) - 1][1]

    def _back(self, at: int) -> int:
        """The place after the last character before a place that is no white space."""
        while at and self.code[at - 1].isspace():
            at -= 1
        return at

    def _name_before(self, end: int) -> int:
        """Where the name begins that ends at a place; the place itself if there is none."""
        at = end
        while at and (self.code[at - 1].isalnum() or self.code[at - 1] in "_$"):
            at -= 1
        return at

    def _chain(self, at: int) -> tuple[int, bool]:
        """Where the expression begins of which the name at a place is the last part, and whether only dots and names lead to it."""
        code, opens = self.code, self._brackets[1]
        plain = True
        while True:
            dot = self._back(at)
            if not dot or code[dot - 1] != ".":
                return at, plain
            end = self._back(dot - 1)
            c = code[end - 1] if end else ""
            if c and c in ")]" and end - 1 in opens:
                plain = False
                first = opens[end - 1]
                end = self._back(first)
                while end and code[end - 1] in "]>":  # further indexes, or type arguments
                    other = opens.get(end - 1) if code[end - 1] == "]" else code.rfind("<", max(0, end - 200), end)
                    if other is None or other < 0:
                        break
                    end = self._back(other)
                name = self._name_before(end)
                if name == end or code[name:end] in NO_CALLS:
                    return first, plain  # an expression in brackets
                at = name
            elif c and c in "\"'":
                return max(0, code.rfind(c, 0, end - 1)), False
            else:
                name = self._name_before(end)
                if name == end:
                    return at, plain
                at = name

    def calls(self) -> list[Call]:
        """Method calls, those that enclose others first."""
        out = []
        closes, declared = self._brackets[0], self._read[1]
        for m in _NAMED.finditer(self.code):
            at, opening = m.start(), m.end() - 1
            if m[1] in NO_CALLS or at in declared or opening not in closes:
                continue
            start, plain = self._chain(at)
            before = self.code[max(0, start - 40) : start].rstrip()
            if before.endswith("@") or (plain and re.search(r"\bnew$", before)):
                continue
            if re.search(r"\bnew$", before):
                start = self.code.rfind("new", 0, start)
            receiver = self.text[start:at].rstrip().rstrip(".").rstrip()
            closing = closes[opening]
            arguments = tuple(parts(self.code[opening + 1 : closing], self.text[opening + 1 : closing]))
            out.append(Call(m[1], receiver if re.fullmatch(r"\w+(?:\s*\.\s*\w+)+", receiver) else None, arguments, start, closing + 1, self.text[start : closing + 1]))
        return sorted(out, key=lambda c: (c.start, -c.end))

    def _value_end(self, at: int, commas: bool) -> int:
        """Where an assigned value ends that begins at a place: at a separator or closing bracket outside its own brackets."""
        closes = self._brackets[0]
        while at < len(self.code):
            c = self.code[at]
            if c in _OPEN and at in closes:
                at = closes[at]
            elif c in ";)]}" or (commas and c == ","):
                break
            at += 1
        return at

    def assignments(self) -> list[tuple[str, str]]:
        """(name, value) of what is assigned or declared in bodies; a declaration of several names gives its last name and value."""
        out, taken = [], -1
        for m in _ASSIGNED.finditer(self.code):
            if m.start() < taken or (m.start() and self.code[m.start() - 1] in "=!<>"):
                continue
            before = self.code[max(0, m.start() - 80) : m.start()].rstrip()
            typed = re.search(r"(?:^|[^\w.])([\w.]+)$|[\]>]$", before) if before != self.code[max(0, m.start() - 80) : m.start()] else None
            if typed and typed[1] not in NO_CALLS and "." not in m[1] and "[" not in m[1]:
                if self.in_type(m.start()):
                    continue
                end = self._value_end(m.end(), False)
                name, value = m[1], ""
                taken = end
                pieces = parts(self.code[m.end() : end], self.text[m.end() : end])
                for k, piece in enumerate(pieces):
                    if k:
                        name, _, piece = (x.strip() for x in piece.partition("="))
                    if re.fullmatch(r"[A-Za-z_$][\w$]*", piece) and piece not in ("null", "true", "false", "this"):
                        name = piece  # a value that is only a name takes the declared one's place
                    elif piece:
                        value = piece
                out.append((name, value))
                # assignments within the value count too
                taken = m.end()
            else:
                end = self._value_end(m.end(), True)
                out.append((self.text[m.start() : m.end(1)], self.text[m.end() : end].strip()))
        return out
