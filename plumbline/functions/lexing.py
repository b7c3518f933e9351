"""SQL tokens. One regular expression covers every input, damaged ones too: an open quote or comment runs to the end."""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<skip>[\s﻿]+|--[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>'(?:[^']++|'')*+(?:'|\Z))
    |(?P<identifier>"(?:[^"]++|"")*+(?:"|\Z)|`(?:[^`]++|``)*+(?:`|\Z)|\[[^\]]*+(?:\]|\Z))
    |(?P<number>[0-9][0-9._]*)
    |(?P<word>[A-Za-z_@$\#][A-Za-z0-9_@$\#]*)
    |(?P<operator>::|->>|->|>=|<=|<>|!=|\|\||&&|==|=>|[+\-*/%=<>])
    |(?P<symbol>.)""",
    re.X | re.S,
)
_SPACE = re.compile(r"[\s﻿]+")
_WRAPPED = re.compile(r"\[(.*)\]|`(.*)`|\"(.*)\"", re.S)
_GLUE = re.compile(r"[A-Za-z0-9_)\]]")


class Token(NamedTuple):
    type: str
    value: str
    normalized: str
    line: int
    column: int


def units(text: str) -> int:
    """Length in UTF-16 units, the measure of columns."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def lex(sql: str | None) -> list[Token]:
    out, line, start = [], 1, 0
    sql = sql or ""
    for m in _TOKEN.finditer(sql):
        kind, value = m.lastgroup, m[0]
        if kind != "skip":
            out.append(Token(kind, value, value.lower() if kind == "word" else value, line, 1 + units(sql[start : m.start()])))
        breaks = value.count("\n") if kind in ("skip", "string", "identifier") else 0
        if breaks:
            line += breaks
            start = m.start() + value.rfind("\n") + 1
    return out


def left_open(sql: str) -> tuple[str, int] | None:
    """What a damaged text leaves open at its end, a quote sign or "/*", and the line on which it begins."""
    last = None
    for last in _TOKEN.finditer(sql):  # only the last one can run to the end
        pass
    if last is None:
        return None
    value, sign = last[0], last[0][:2] if last["skip"] else last[0][:1]
    comment = sign == "/*" and not (len(value) > 3 and value.endswith("*/"))
    quote = last.lastgroup in ("string", "identifier") and sign in "'\"`" and value.count(sign) % 2
    return (sign, sql.count("\n", 0, last.start()) + 1) if comment or quote else None


def without_comments(sql: str | None) -> str:
    """Comments become spaces; line breaks and positions stay. Quotes are respected."""
    return _TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m["skip"] and m[0][:1] in "-/" else m[0], sql or "")


def text_of(tokens: list[Token]) -> str:
    """Canonical spacing: none before , ) ; . nor after . or (, and an opening parenthesis sticks to a name."""
    out = ""
    for t in tokens:
        tight = not out or t.value in (",", ")", ";", ".") or out[-1] in ".(" or t.value == "(" and _GLUE.match(out[-1])
        out += t.value if tight else " " + t.value
    return out


def name_of(text: str | None) -> str:
    """Identifier without its outer quotes, lower-cased."""
    return display(text).lower()


def display(text: str | None) -> str:
    text = (text or "").strip()
    m = _WRAPPED.fullmatch(text)
    return next(g for g in m.groups() if g is not None) if m else text


def compact(tokens: list[Token]) -> str:
    return re.sub(r"\s*\.\s*", ".", text_of(tokens)).strip()


def squeeze(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


def key_of(text: str | None) -> str:
    """How evidence texts are compared."""
    return squeeze(text).lower()


def depths(tokens: list[Token]) -> list[int]:
    """Parenthesis depth at every token; an opening one counts as inside, a closing one as outside."""
    out, d = [], 0
    for t in tokens:
        d = d + 1 if t.value == "(" else max(0, d - 1) if t.value == ")" else d
        out.append(d)
    return out


def split(tokens: list[Token], by=",") -> list[list[Token]]:
    """Groups between top-level delimiters (a symbol, or a lower-case word); a trailing empty group is dropped."""
    out: list[list[Token]] = [[]]
    for t, d in zip(tokens, depths(tokens), strict=True):
        if d == 0 and (t.normalized if t.type == "word" else t.value) == by:
            out.append([])
        else:
            out[-1].append(t)
    return out if out[-1] or len(out) == 1 else out[:-1]


def closing(tokens: list[Token], at: int) -> int:
    """Place of the parenthesis that closes the one at `at`, or the last place."""
    d = 0
    for i in range(at, len(tokens)):
        d += (tokens[i].value == "(") - (tokens[i].value == ")")
        if d == 0:
            return i
    return len(tokens) - 1
