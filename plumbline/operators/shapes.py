"""Rows of statements that differ in numbers only: worked out once for a shape, then filled in.

A shape is a statement whose longer numbers (digit runs outside words, or anywhere in a string) are other numbers of the
same lengths. The analyser's patterns tell no digit from another, so clauses, spans and rules stay the same; what can
differ is texts, which are compared, and ids, which are digests. So numbers get equal stand-ins where they are equal and
others where not; a statement is left as it is where a number's value counts (LIMIT, OFFSET), where one number holds
another, where the notes or the analyser's own texts have it, and where quotes or comments hide what is a string. Two sets
of stand-ins must give the same rows but for themselves and for digests of texts that hold them (see digests), or the shape's
statements are reviewed one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.digests import Orders, Traced, Unlike, alike

#: Statements of at most SHORT characters, and shapes, that a task remembers: generated statements repeat.
KEPT, SHORT = 2_000, 2_000
#: Shorter numbers stay as they are; at most MOST different ones get stand-ins; numbers in the analyser's own texts.
LEAST, MOST, OWN = 3, 6, frozenset({"500", "8601"})
_CARE = re.compile(r"[\"`\[]|--|/\*|limit|offset|\bline\s", re.I)
_PLACES = re.compile(r"'[^']*'?|(?<![A-Za-z0-9_@$#])[0-9]+")
_RUN = re.compile(r"[0-9]+")
#: Two sets of digits that stand-ins begin.
FIRST = ("739158204673915820", "861740395286174039", "694827153069482715", "957316428095731642", "781462903578146290", "846093571284609357")
SECOND = ("428617930542861793", "573902861457390286", "315784096231578409", "264971835026497183", "492038176549203817", "137529640813752964")


def renamed(sql: str, names: dict[str, str]) -> str:
    one = lambda m: names.get(m[0], m[0])
    return _PLACES.sub(lambda m: _RUN.sub(one, m[0]) if m[0][0] == "'" else one(m), sql)


def _apart(runs: list[str], fixed: frozenset | set) -> bool:
    """Whether no number is fixed or a part of another."""
    return not any(a in fixed for a in runs) and not any(a in b for i, a in enumerate(runs) for j, b in enumerate(runs) if i != j)


def numbers(sql: str, fixed: frozenset | set) -> list[str] | None:
    """The numbers that can have stand-ins, once each; None if a statement has to stay as it is."""
    if _CARE.search(sql):
        return None
    found = dict.fromkeys(r for m in _PLACES.finditer(sql) for r in (_RUN.findall(m[0]) if m[0][0] == "'" else (m[0],)) if len(r) >= LEAST)
    if not found:
        return []
    runs = list(found)
    rest = [r for r in dict.fromkeys(_RUN.findall(sql)) if r not in found]
    if len(runs) > MOST or any(len(r) > len(FIRST[0]) for r in runs) or not _apart(runs, fixed) or any(a in b or b in a for a in runs for b in rest):
        return None
    return runs


def stand_ins(sql: str, runs: list[str], fixed: frozenset | set, digits: tuple[str, ...]) -> tuple[str, list[str]] | None:
    """The shape with stand-ins made of digits, and these; None if they could be taken for another number."""
    rest = [r for r in _RUN.findall(sql) if r not in runs]
    new = ["".join(x for x in d if x not in rest)[: len(r)] for d, r in zip(digits, runs, strict=False)]
    if not _apart(new, fixed) or any(len(a) < len(r) for a, r in zip(new, runs, strict=True)) or any(a in b or b in a for b in rest for a in new):
        return None
    shape = renamed(sql, dict(zip(runs, new, strict=True)))
    # a number that stands in a word, too, is still there
    return None if any(r in shape for r in runs if r not in new) else (shape, new)


class Entry:
    """Rows, and where they have numbers of the statement: row, column, and the value with its parts. With digests, these
    are texts that traced makes of the numbers of many statements."""

    def __init__(self, rows: list[tuple], holes: list[tuple[int, int, Callable]] = (), traced: Traced | None = None):
        self.rows, self.holes, self.traced, self.halves = rows, holes, traced, None


def _each(value, f):
    return f(value) if isinstance(value, str) else [_each(v, f) for v in value] if isinstance(value, (list, tuple)) else value


def _template(rows: list[tuple], new: list[str]) -> Entry:
    marks = re.compile(f"(?<![0-9])({'|'.join(new)})(?![0-9])")
    place = {r: i for i, r in enumerate(new)}
    cuts: dict[str, list] = {}

    def parts(text: str):
        cut = marks.split(text)
        return [place[x] if i % 2 else x for i, x in enumerate(cut)]

    holes = []
    for i, row in enumerate(rows):
        for k, value in enumerate(row):
            found = False

            def seen(text):
                nonlocal found
                found = found or bool(marks.search(text))
                return parts(text)

            cut = _each(value, seen)
            if found:
                holes.append((i, k, cuts.setdefault(repr(cut), cut), isinstance(value, str)))
    return Entry(rows, holes)


def _filled(cut, whole: bool, values: list[str]):
    if whole:
        return "".join([values[x] if type(x) is int else x for x in cut])
    return [v if not isinstance(v, list) else _filled(v, True, values) for v in cut]


class Memory:
    """Rows of statements by text and by shape, for one task."""

    def __init__(self, rows_of: Callable[[str, str], list[tuple]]):
        self.rows_of, self.texts, self.shapes, self.notes, self.layouts, self.orders = rows_of, {}, {}, {}, {}, Orders()

    def fixed(self, notes: str) -> set:
        found = self.notes.get(notes)
        if found is None:
            if len(self.notes) >= 64:
                self.notes.clear()
            found = self.notes[notes] = OWN | set(_RUN.findall(notes))
        return found

    def find(self, sql: str, notes: str) -> tuple[Entry, list[str] | None]:
        """The entry of a statement, and the numbers to fill it with (None: it is whole)."""
        found = self.texts.get((sql, notes))
        if found is not None:
            return found, None
        if len(sql) > SHORT:
            return Entry(self.rows_of(sql, notes)), None
        fixed = self.fixed(notes)
        runs = numbers(sql, fixed)
        first = stand_ins(sql, runs, fixed, FIRST) if runs else None
        if first is None:
            return self._whole(sql, notes), None
        shape, new = first
        known = self.shapes.get((shape, notes), self)
        if known is self:  # its first statement: most shapes of a mixed corpus have no second one
            if len(self.shapes) >= KEPT:
                self.shapes.clear()
            self.shapes[shape, notes] = None
            return Entry(self.rows_of(sql, notes)), None
        if known is None:
            known = self.shapes[shape, notes] = self._shaped(sql, notes, runs, fixed, shape, new)
        return (known, runs) if known.rows is not None and not known.traced else (Entry(self.rows_of(sql, notes)), None)

    def layout(self, mask: str):
        if mask not in self.layouts:
            if len(self.layouts) >= KEPT:
                self.layouts.clear()
            self.layouts[mask] = layout(mask)
        return self.layouts[mask]

    def shape(self, sql: str, notes: str) -> Entry | None:
        """The entry of a statement's shape, of which there are several; None if it has none."""
        fixed = self.fixed(notes)
        runs = numbers(sql, fixed)
        first = stand_ins(sql, runs, fixed, FIRST) if runs else None
        if first is None:
            return None
        shape, new = first
        known = self.shapes.get((shape, notes))
        if known is None:
            if len(self.shapes) >= KEPT:
                self.shapes.clear()
            known = self.shapes[shape, notes] = self._shaped(sql, notes, runs, fixed, shape, new)
        return known

    def _whole(self, sql: str, notes: str) -> Entry:
        if len(self.texts) >= KEPT:
            self.texts.clear()
        found = self.texts[sql, notes] = Entry(self.rows_of(sql, notes))
        return found

    def _shaped(self, sql, notes, runs, fixed, shape, new) -> Entry:
        """The shape's entry; one without rows if they hold more of the numbers than their texts."""
        other = stand_ins(sql, runs, fixed, SECOND)
        if other is None or set(other[1]) & set(new):
            return Entry(None)
        rows, again = self.rows_of(shape, notes), self.rows_of(other[0], notes)
        back = dict(zip(other[1], new, strict=True))
        marks = re.compile(f"(?<![0-9])({'|'.join(other[1])})(?![0-9])")
        same = [tuple(_each(v, lambda t: marks.sub(lambda m: back[m[0]], t)) for v in row) for row in again]
        if [tuple(_each(v, str) for v in row) for row in rows] == same:
            return _template(rows, new)
        try:
            traced = Traced(self.rows_of, notes, (shape, new), other, self.orders)
        except Unlike:
            return Entry(None)
        return Entry(traced.rows, [(i, k, [x], True) for x, (i, k) in enumerate(traced.spots)], traced)


def _masked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The bytes of texts, where each begins, and the texts with 0 for every digit."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[: at[-1]] if data is not None else np.zeros(0, np.uint8)
    zeros = np.where((data >= 48) & (data <= 57), np.uint8(48), data)
    return data, at[:-1].astype(np.int64), pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(zeros)])


def layout(mask: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
    """Places, in bytes, of the numbers of a masked text that can have stand-ins, and of the others; None if there are none."""
    if _CARE.search(mask):
        return None
    found = [(m.start() + r.start(), m.start() + r.end()) for m in _PLACES.finditer(mask) for r in _RUN.finditer(m[0])]
    own = {x for x in found if x[1] - x[0] >= LEAST}
    if not own or any(b - a > len(FIRST[0]) for a, b in own):
        return None
    to = (lambda i: i) if mask.isascii() else (lambda i: len(mask[:i].encode()))
    runs = [m.span() for m in _RUN.finditer(mask)]
    return [(to(a), to(b)) for a, b in runs if (a, b) in own], [(to(a), to(b)) for a, b in runs if (a, b) not in own]


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether the shorter text is a part of the longer one."""
    a, b = (a, b) if a.shape[1] <= b.shape[1] else (b, a)
    n = a.shape[1]
    return np.logical_or.reduce([(b[:, o : o + n] == a).all(axis=1) for o in range(b.shape[1] - n + 1)])


#: Entry, the places of its statements, and their numbers: None (it is whole), texts that hold for all, or an array of each.
Found = tuple[Entry, "np.ndarray | int", "list[str] | list[pa.Array] | None"]


def found(memory: Memory, sql: pa.Array, notes: pa.Array) -> list[Found]:
    """What memory has for statements, looked up by shape where several can be."""
    sql = (sql.fill_null("") if sql.null_count else sql).cast(pa.string())
    notes = notes if pa.types.is_dictionary(notes.type) else notes.fill_null("").dictionary_encode()
    data, begins, masks = _masked(sql)
    masks = masks.dictionary_encode()
    kinds = np.stack([masks.indices.to_numpy(), notes.indices.to_numpy()], axis=1)
    out: list[Found] = []

    def singly(places, note):
        texts = sql.take(pa.array(places)).dictionary_encode()
        which = texts.indices.to_numpy()
        order = np.argsort(which, kind="stable")
        for text, some in zip(texts.dictionary.to_pylist(), np.split(order, np.flatnonzero(np.diff(which[order])) + 1), strict=True):
            e, values = memory.find(text, note)
            out.append((e, places[some], values))

    for places in alike(kinds):
        mask, note = masks.dictionary[int(kinds[places[0], 0])].as_py(), notes.dictionary[int(kinds[places[0], 1])].as_py() or ""
        spans = memory.layout(mask) if len(places) > 1 and len(mask) <= SHORT else None
        if spans is None:
            singly(places, note)
            continue
        at, (own, rest), fixed = begins[places], spans, memory.fixed(note)
        cut = lambda a, b, at=at: data[at[:, None] + np.arange(a, b)]
        values, others = [cut(*x) for x in own], [cut(*x) for x in rest]
        bad = np.zeros(len(places), dtype=bool)
        first = np.tile(np.arange(len(own), dtype=np.int8), (len(places), 1))
        for j, b in enumerate(values):
            known = np.array([x for x in fixed if len(x) == b.shape[1]], dtype=f"S{b.shape[1]}")
            bad |= np.isin(b.view(f"S{b.shape[1]}").ravel(), known)
            for i in range(j - 1, -1, -1):
                if values[i].shape[1] == b.shape[1]:
                    first[(values[i] == b).all(axis=1), j] = i
                else:
                    bad |= _within(values[i], b)
            for x in others:
                bad |= _within(x, b)
        if bad.any():
            singly(places[bad], note)
        good = np.flatnonzero(~bad)
        for some in alike(np.concatenate([first.view(np.uint8), *others], axis=1)[good]):
            some = good[some]
            e = memory.shape(sql[int(places[some[0]])].as_py(), note) if len(some) > 1 else None
            if e is None or e.rows is None:
                singly(places[some], note)
                continue
            distinct = dict.fromkeys(first[some[0]].tolist())
            if e.traced:
                for few in (some[i : i + e.traced.step] for i in range(0, len(some), e.traced.step)):
                    alone, texts = e.traced.texts([values[i][few] for i in distinct])
                    if alone.any():
                        singly(places[few[alone]], note)
                    if texts:
                        out.append((e, places[few[~alone]], texts))
                continue
            texts = [values[i][some].view(f"S{values[i].shape[1]}").ravel() for i in distinct]
            out.append((e, places[some], [pa.array(x, pa.binary()).cast(pa.string()) for x in texts]))
    return out


def _joined(cut: list, values: list[pa.Array], n: int) -> pa.Array:
    """Texts of parts, for n statements."""
    parts = [values[x] if type(x) is int else x for x in cut if x != ""]
    if not any(isinstance(x, pa.Array) for x in parts):
        return pa.repeat("".join(parts), n)
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, "")


def _spelled(cut: list, whole: bool, values: list, n: int, kind: pa.DataType) -> pa.Array:
    """The values of a hole for n statements."""
    if not isinstance(values[0], pa.Array):
        return pa.array([_filled(cut, whole, values)] * n, kind)
    if whole and pa.types.is_string(kind):
        return _joined(cut, values, n)
    if pa.types.is_list(kind) and pa.types.is_string(kind.value_type) and all(isinstance(v, list) and all(isinstance(x, (str, int)) for x in v) for v in cut):
        m = len(cut)
        flat = pa.concat_arrays([_joined(v, values, n) for v in cut]).take(pa.array((np.arange(m) * n + np.arange(n)[:, None]).ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), flat, type=kind)
    return pa.array([_filled(cut, whole, list(x)) for x in zip(*(v.to_pylist() for v in values), strict=True)], kind)


def tables(entries: list[Found], keys: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the keys and rows of entries, in the order of the keys."""
    pool, start = [], {}
    at, counts = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    for e, places, _ in entries:
        if id(e) not in start:
            start[id(e)] = len(pool)
            pool += e.rows
        at[places], counts[places] = start[id(e)], len(e.rows)
    begins = np.cumsum(counts) - counts
    total = int(counts.sum())
    index = np.repeat(at - begins, counts) + np.arange(total, dtype=np.int64)
    texts: dict[int, list[tuple[np.ndarray, list]]] = {}  # by column: values of single statements
    more: dict[int, list[tuple[np.ndarray, pa.Array]]] = {}
    for e, places, values in entries:
        if values is None:
            continue
        begin, made = begins[places], {}
        for row, column, cut, whole in e.holes:
            if begin.ndim == 0:
                texts.setdefault(column, []).append((begin + row, _filled(cut, whole, values)))
                continue
            key = (id(cut), whole)
            if key not in made:
                made[key] = _spelled(cut, whole, values, len(begin), schema.field(column + 1).type)
            more.setdefault(column, []).append((begin + row, made[key]))
    for column, some in texts.items():
        more.setdefault(column, []).append((np.array([x for x, _ in some]), pa.array([x for _, x in some], schema.field(column + 1).type)))
    out = [keys.take(pa.array(np.repeat(np.arange(len(keys), dtype=np.int64), counts)))]
    columns = list(zip(*pool, strict=True)) if pool else [()] * (len(schema) - 1)
    for i, values in enumerate(columns):
        where, parts = index, [pa.array(values, schema.field(i + 1).type)]
        if i in more:
            where, n = index.copy(), len(values)
            own: dict[int, int] = {}
            for places, array in more[i]:
                if id(array) not in own:
                    own[id(array)] = n
                    parts.append(array)
                    n += len(array)
                where[places] = np.arange(own[id(array)], own[id(array)] + len(array))
        out.append((pa.concat_arrays(parts) if len(parts) > 1 else parts[0]).take(pa.array(where)))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def noted(batches: Iterator[pa.RecordBatch], notes: str) -> Iterator[pa.RecordBatch]:
    """Batches of key, sql and the same notes for all, which are sent once only."""
    for b in batches:
        column = pa.DictionaryArray.from_arrays(pa.array(np.zeros(b.num_rows, dtype=np.int32)), pa.array([notes]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column], names=["query_id", "sql", "schema_text"])


#: Statements that are looked up, and whose rows are put together, at a time; rows of so many are sent once for all of them.
LOOKED, CHUNK, SHARED = 10_000, 2_000, 4


def shared_type(key: str, columns: dict[str, str]) -> str:
    """Columns that each() sends: keys of statements with the same rows and these, or a key and a row; the other two are null."""
    return f"_keys array<{key}>, _rows array<struct<{', '.join(f'_{i} {kind}' for i, kind in enumerate(columns.values()))}>>, query_id {key}, {', '.join(f'{c} {kind}' for c, kind in columns.items())}"


def _split(entries: list[Found]) -> tuple[list[tuple[Entry, np.ndarray]], list[Found]]:
    """Rows that several statements have, and the others; of a shape's rows only those with numbers differ."""
    shared, own = [], []
    for e, places, values in entries:
        if not isinstance(places, np.ndarray) or len(places) < SHARED:
            own.append((e, places, values))
            continue
        if values is None or not e.holes:
            shared.append((e, places))
            continue
        if e.halves is None:
            differ = {row: k for k, row in enumerate(sorted({h[0] for h in e.holes}))}
            e.halves = Entry([r for i, r in enumerate(e.rows) if i not in differ]), Entry([e.rows[i] for i in differ], [(differ[i], *rest) for i, *rest in e.holes])
        shared.append((e.halves[0], places))
        own.append((e.halves[1], places, values))
    return [x for x in shared if x[0].rows], own


def _lists(arrays: list[pa.Array], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *[len(x) for x in arrays]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(arrays), type=kind)


def _together(shared: list[tuple[Entry, np.ndarray]], keys: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    kind = schema.field(1).type
    fields = list(kind.value_type)
    rows = [pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*e.rows, strict=True), fields, strict=True)], fields=fields) for e, _ in shared]
    some = [_lists([keys.take(pa.array(places)) for _, places in shared], schema.field(0).type), _lists(rows, kind)]
    return pa.RecordBatch.from_arrays([*some, *[pa.nulls(len(shared), f.type) for f in list(schema)[2:]]], schema=schema)


def _between(entries: list[Found], low: int, high: int) -> list[Found]:
    out = []
    for e, places, values in entries:
        a, b = np.searchsorted(places, (low, high))
        if a < b:
            out.append((e, places[a:b] - low, [v.slice(a, b - a) if isinstance(v, pa.Array) else v for v in values] if values is not None else None))
    return out


def each(batches: Iterator[pa.RecordBatch], rows_of: Callable[[str, str], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of rows_of(sql, notes) for batches of key, sql, notes, as shared_type says."""
    memory, flat = Memory(rows_of), pa.schema(list(schema)[2:])
    for batch in batches:
        for b in (batch.slice(i, LOOKED) for i in range(0, batch.num_rows, LOOKED)):
            shared, own = _split(found(memory, b.column(1), b.column(2)))
            if shared:
                yield _together(shared, b.column(0), schema)
            for i in range(0, b.num_rows if own else 0, CHUNK):
                if some := _between(own, i, i + CHUNK):
                    made = tables(some, b.column(0).slice(i, CHUNK), flat)
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(made.num_rows, schema.field(k).type) for k in (0, 1)], *made.columns], schema=schema)


def expanded(made: DataFrame, columns: Sequence[str]) -> DataFrame:
    """query_id and columns of what each() sends."""
    by_row = made.select(F.col("_rows").isNull().alias("_own"), "_keys", "query_id", *columns, F.inline_outer("_rows"))
    rows = by_row.select("_own", F.explode_outer("_keys").alias("_key"), "query_id", *columns, *[f"_{i}" for i in range(len(columns))])
    either = lambda own, shared: F.when(F.col("_own"), F.col(own)).otherwise(F.col(shared)).alias(own)
    return rows.select(either("query_id", "_key"), *[either(c, f"_{i}") for i, c in enumerate(columns)])


def grouped(batches: Iterator[pa.RecordBatch], rows_of: Callable[[list[tuple[str, str]]], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of rows_of([(sql, notes), ...]) for all statements of a key; batches are sorted by it."""
    memory = Memory(lambda sql, notes: rows_of([(sql, notes)]))
    kind = schema.field(0).type
    keys, groups = [], []

    def made(keys, groups):
        some = [memory.find(*g[0]) if len(g) == 1 else (Entry(rows_of(g)), None) for g in groups]
        return tables([(e, i, values) for i, (e, values) in enumerate(some)], pa.array(keys, kind), schema)

    for b in batches:
        for key, sql, notes in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if keys and keys[-1] == key:
                groups[-1].append((sql or "", notes or ""))
                continue
            if len(keys) >= CHUNK:
                yield made(keys, groups)
                keys, groups = [], []
            keys.append(key)
            groups.append([(sql or "", notes or "")])
    if keys:
        yield made(keys, groups)
