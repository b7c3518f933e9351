"""Rows with digests (ids, documents sorted by ids, digests of them) for many statements of a shape at a time.

A shape is reviewed with stand-ins while its digests are watched: texts that hold numbers or digests of such texts become
templates, and all numbers of a shape's statements have the same lengths, so a text of n statements is a matrix of n rows.
Digests are worked out down its columns. Records are sorted by ids, so statements fall into orders; the shape is put
together once for each order by the same code as a single statement, told by `exports.placed` where each id belongs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from plumbline.functions.exports import placed
from plumbline.functions.identity import watched

_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3
_ID = re.compile(r"(.*-)([0-9a-f]{16})((?:-r[0-9]+)?)", re.S)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Bytes of texts of orders that a task keeps, and of a text of all statements that are made at a time.
KEPT, BYTES = 1 << 26, 1 << 25


class Unlike(Exception):
    """A shape whose rows can't be made this way."""


def alike(rows: np.ndarray) -> list[np.ndarray]:
    """Places of equal rows."""
    if rows.shape[1] == 0 or not len(rows):
        return [np.arange(len(rows))] if len(rows) else []
    flat = np.ascontiguousarray(rows)
    _, which = np.unique(flat.view(np.dtype((np.void, flat.shape[1] * flat.itemsize))).ravel(), return_inverse=True)
    order = np.argsort(which, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(which[order])) + 1)


class Orders(dict):
    """Texts by shape and order, and orders that came once, in all as many bytes as KEPT."""

    held = 0

    def keep(self, key: tuple, found: tuple[list, list] | None) -> None:
        took = 200 + sum(t.codes.nbytes + t.cols.nbytes + t.src.nbytes for t in (*found[0], *found[1])) if found else 200
        if self.held + took > KEPT:
            self.clear()
            self.held = 0
        self[key], self.held = found, self.held + took


class Text:
    """A text as codes, and the columns of it that are columns of a statement's values."""

    def __init__(self, parts: list, at: list[tuple[int, int]], to_codes: Callable[[str], np.ndarray]):
        codes, cols, src, n = [], [], [], 0
        for x in parts:
            if type(x) is int:
                a, b = at[x]
                cols.append(np.arange(n, n + b - a))
                src.append(np.arange(a, b))
                codes.append(np.zeros(b - a, np.uint8))
            else:
                codes.append(to_codes(x))
            n += len(codes[-1])
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
        self.cols, self.src = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (cols, src))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def fnv_of(texts: list[tuple[Text, int, int]], values: np.ndarray) -> np.ndarray:
    """Digests of texts of one length, each for statements from one place to another; values has a row for each byte of theirs."""
    first, n = texts[0][0], values.shape[1]
    chars = np.empty((len(first.codes), n), np.result_type(*[t.codes for t, _, _ in texts]))
    for t, a, b in texts:
        chars[:, a:b] = t.codes[:, None]
        chars[t.cols, a:b] = values[t.src, a:b]
    h, prime = np.full(n, _OFFSET, np.uint64), np.uint64(_PRIME)
    for row in chars:
        np.bitwise_xor(h, row, out=h)
        np.multiply(h, prime, out=h)
    return h


def spelled(digests: np.ndarray) -> np.ndarray:
    """Hexadecimal digits of digests, a row for each digit."""
    return _DIGITS[(digests[None, :] >> np.arange(60, -4, -4, dtype=np.uint64)[:, None]) & np.uint64(15)]


class Traced:
    """rows: those of the shape; spots: rows and columns whose texts differ by statement."""

    def __init__(self, rows_of: Callable, notes: str, shape: tuple[str, list[str]], other: tuple[str, list[str]], orders: Orders):
        self.rows_of, self.sql, self.notes, self.new, self.orders = rows_of, shape[0], notes, shape[1], orders
        self.marks = rf"(?<![0-9])(?:{'|'.join(self.new)})(?![0-9])"
        asked: dict[str, None] = {}
        with placed(lambda id: asked.setdefault(id) or id), watched() as seen:
            self.rows = rows_of(self.sql, notes)
        self._compare(seen, other)
        numbers = {r: i for i, r in enumerate(self.new)}
        self.at = [(0, 0)] * len(numbers)
        end = 0
        for i, r in enumerate(self.new):
            self.at[i] = (end, end := end + len(r))
        ids = sorted(asked)
        place = {id: -i for i, id in enumerate(ids)}
        with placed(place.__getitem__), watched() as turned:
            rows_of(self.sql, notes)
        #: Digests that hang on no order, and those of them that hang on numbers.
        self.steady, self.own, self.early = {h for h in seen if h in turned}, dict(numbers), []
        for h in (h for h in seen if h in self.steady):
            parts = self._cut(seen[h], self.own)
            if any(type(x) is int for x in parts):
                self.early.append(Text(parts, self.at, _points))
                self.own[h] = len(self.at)
                self.at.append((end, end := end + 16))
        self.width = end
        #: Ids by what stands before the digest: digests in the order of the shape, those that differ by place.
        self.kinds: dict[str, list[str]] = {}
        for id in ids:
            m = _ID.fullmatch(id)
            if not m or m[2] not in self.steady:
                raise Unlike
            self.kinds.setdefault(m[1], [])
            if m[2] not in self.kinds[m[1]]:
                self.kinds[m[1]].append(m[2])
        self.spots, self.late = self._ordered({k: {h: i for i, h in enumerate(v)} for k, v in self.kinds.items()})
        self.lengths = [len(t.codes) for t in self.spots.values()]
        self.step = max(1, BYTES // max([1, *self.lengths]))

    def _cut(self, text: str, places: dict[str, int]) -> list:
        """Parts of a text: places of numbers and digests of the statement, and what stands between."""
        out, end = [], 0
        for m in self._pattern(places).finditer(text):
            if m[0] in places:
                out += [text[end : m.start()], places[m[0]]]
                end = m.end()
        return [x for x in [*out, text[end:]] if x != ""]

    def _pattern(self, places: dict[str, int]) -> re.Pattern:
        return re.compile("|".join([*(set(places) - set(self.new)), *getattr(self, "steady", ()), self.marks]))

    def _compare(self, seen: dict[str, str], other: tuple[str, list[str]]) -> None:
        """Other stand-ins must give the same rows but for themselves and for digests, in the same order."""
        by_text, back, marks = {t: h for h, t in seen.items()}, dict(zip(other[1], self.new, strict=True)), rf"(?<![0-9])(?:{'|'.join(other[1])})(?![0-9])"
        to: dict[str, str] = {}

        def as_first(text):
            for h in list(more)[len(to) :]:
                t = swapped(more[h])
                if t not in by_text:
                    raise Unlike
                to[h] = by_text[t]
            return swapped(text)

        def swapped(text):
            return re.sub("|".join([*to, marks]), lambda m: to.get(m[0]) or back[m[0]], text)

        def each(value):
            return as_first(value) if isinstance(value, str) else [each(v) for v in value] if isinstance(value, (list, tuple)) else value

        def plain(value):
            return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value

        with placed(as_first), watched() as more:
            rows = self.rows_of(other[0], self.notes)
        if each(rows) != plain(self.rows):
            raise Unlike

    def _ordered(self, ranks: dict[str, dict[str, int]]) -> tuple[dict[tuple[int, int], Text], list[Text]]:
        """Texts of rows, and late digests' texts, with ids in an order."""

        def place(id):
            m = _ID.fullmatch(id)
            return m[1], ranks[m[1]][m[2]], m[3]

        with placed(place), watched() as seen:
            rows = self.rows_of(self.sql, self.notes)
        own, at, late = dict(self.own), list(self.at), []
        for h in seen:
            if h not in self.steady:
                late.append(Text(self._cut(seen[h], own), at, _points))
                own[h] = len(at)
                at.append((at[-1][1], at[-1][1] + 16))
        spots = {}
        for i, row in enumerate(rows):
            for k, value in enumerate(row):
                for text in [value] if isinstance(value, str) else value if isinstance(value, (list, tuple)) else ():
                    parts = self._cut(text, own)
                    if any(type(x) is int for x in parts):
                        if text is not value:
                            raise Unlike
                        spots[i, k] = Text(parts, at, _bytes)
        return spots, late

    def _order(self, key: bytes, orders: list[np.ndarray], n: int) -> tuple | None:
        """The texts of an order; None if these statements are better reviewed one by one."""
        if (self, key) in self.orders:
            return self.orders[self, key]
        if n == 1 and (self, key, "once") not in self.orders:
            self.orders.keep((self, key, "once"), None)
            return None
        try:
            spots, late = self._ordered({k: {v[j]: i for i, j in enumerate(o.tolist())} for (k, v), o in zip(self.kinds.items(), orders, strict=True)})
            same = list(spots) == list(self.spots) and [len(t.codes) for t in (*spots.values(), *late)] == [*self.lengths, *[len(t.codes) for t in self.late]]
        except Unlike:
            same = False
        found = (list(spots.values()), late) if same else None
        self.orders.keep((self, key), found)
        return found

    def texts(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
        """Which of the statements with numbers (a row each) are to be reviewed one by one, and the spots' texts of the others."""
        n = len(numbers[0])
        values = np.empty((self.width, n), np.uint8)
        for (a, b), x in zip(self.at, numbers, strict=False):
            values[a:b] = x.T
        made = {}
        for i, t in enumerate(self.early, len(numbers)):
            made[i] = fnv_of([(t, 0, n)], values)
            values[slice(*self.at[i])] = spelled(made[i])
        orders, bad = [], np.zeros(n, dtype=bool)
        for hashes in self.kinds.values():
            ids = np.stack([made[self.own[h]] if h in self.own else np.full(n, int(h, 16), np.uint64) for h in hashes], axis=1)
            orders.append(np.argsort(ids, axis=1, kind="stable"))
            ids = np.take_along_axis(ids, orders[-1], axis=1)
            bad |= (ids[:, 1:] == ids[:, :-1]).any(axis=1)
        keys = np.concatenate([np.zeros((n, 1), np.uint16), *[o.astype(np.uint16) for o in orders]], axis=1)
        groups = []
        for some in alike(keys):
            found = self._order(keys[some[0]].tobytes(), [o[some[0]] for o in orders], len(some))
            if found is None:
                bad[some] = True
            elif not bad[some].all():
                groups.append((found, some[~bad[some]]))
        if not groups:
            return bad, []
        which = np.concatenate([some for _, some in groups])
        ends = np.cumsum([0, *[len(some) for _, some in groups]])
        spans = [(found, int(a), int(b)) for (found, _), a, b in zip(groups, ends, ends[1:], strict=False)]
        values = np.ascontiguousarray(values[:, which])
        for k in range(len(self.late)):
            digests = fnv_of([(late[k], a, b) for (_, late), a, b in spans], values)
            values = np.concatenate([values, spelled(digests)])
        across, back, out = np.ascontiguousarray(values.T), np.argsort(which), []
        for k, length in enumerate(self.lengths):
            text = np.empty((len(which), length), np.uint8)
            for (spots, _), a, b in spans:
                text[a:b] = spots[k].codes
                text[a:b, spots[k].cols] = across[a:b, spots[k].src]
            ends = np.arange(len(which) + 1, dtype=np.int32) * length
            out.append(pa.Array.from_buffers(pa.string(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(text[back])]))
        return bad, out
