"""A statement with one clause a line, and the raw lines that each formatted line comes from.

Tokens are first classified, by their words and depths, into pieces that begin or end a line; pieces are then grouped into
lines, and each line is spelled and its raw lines are taken from its tokens.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from plumbline.functions.lexing import Token, depths, lex

#: What begins a line outside parentheses, and the indent it brings (none: that of the line before).
BEGINS: dict[str, int | None] = dict.fromkeys(("with", "select", "from", "where", "having", "limit", "offset", "group by", "order by"), 0) | {"and": 1, "or": 1}
BEGINS |= dict.fromkeys(("join", "inner join", "left join", "right join", "full join", "cross join"))
#: Other words written in capitals.
_CAPITALS = {"as", "between", "case", "else", "end", "in", "is", "like", "not", "null", "on", "using", "when", "then"}
DEEPEST = 6


class Piece(NamedTuple):
    text: str
    first: int  # raw lines
    last: int
    depth: int
    key: str  # in BEGINS, "," outside parentheses, or ""


def _pieces(tokens: list[Token]) -> list[Piece]:
    words = [t.normalized if t.type == "word" else "" for t in tokens]
    out, skip = [], -1
    for i, (t, word, inside) in enumerate(zip(tokens, words, depths(tokens), strict=True)):
        if i == skip:
            continue
        level = inside - (t.value == "(")  # a parenthesis stands outside what it encloses
        both = f"{word} {words[i + 1]}" if word and i + 1 < len(words) else ""
        key = next((x for x in (both, word, t.value) if x in BEGINS or x == ","), "") if level == 0 else ""
        if key == both and key:
            skip = i + 1
        text = key.upper() if key in BEGINS else word.upper() if word in _CAPITALS else t.value
        out.append(Piece(text, t.line, tokens[max(i, skip)].line, level, key))
    return out


def _grouped(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Indent and pieces of each line: it begins where a piece says so, after a comma, or where the raw text goes on in
    another line."""
    out: list[tuple[int, list[Piece]]] = []
    for before, p in zip([None, *pieces], pieces, strict=False):
        indent = out[-1][0] if out else 0
        comma, lower = before is not None and before.key == ",", before is not None and p.first > before.last
        if comma:
            indent = 1
        elif lower:
            indent = min(DEEPEST, p.depth)
        if BEGINS.get(p.key) is not None:
            indent = BEGINS[p.key]
        if not out or comma or lower or p.key in BEGINS:
            out.append((indent, []))
        out[-1][1].append(p)
    return out


def _spelled(pieces: list[Piece]) -> tuple[str, list[tuple[int, int]]]:
    """A line's text, and the first and last raw line of each of its rows (a string may hold line ends)."""
    text, rows = "", {}
    for p in pieces:
        tight = not text or p.text in (",", ")", ";", ".") or text[-1] in "(." or p.text == "(" and re.match(r"[A-Za-z0-9_*]", text[-1])
        row, more = text.count("\n"), p.text.count("\n")
        text += p.text if tight else " " + p.text
        for k in range(more + 1):
            rows.setdefault(row + k, []).extend([p.first + k, p.first + k if more else p.last])
    return text, [(min(x), max(x)) for _, x in sorted(rows.items())]


def format_sql(sql: str | None) -> tuple[str, list[dict]]:
    """Formatted text, and {formattedLine, rawLineStart, rawLineEnd} of each of its lines."""
    spelled = [(indent, *_spelled(pieces)) for indent, pieces in _grouped(_pieces(lex(sql)))]
    ranges = [r for _, _, rows in spelled for r in rows]
    return "\n".join("  " * indent + text for indent, text, _ in spelled), [{"formattedLine": n, "rawLineStart": a, "rawLineEnd": b} for n, (a, b) in enumerate(ranges, 1)]
