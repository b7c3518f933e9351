"""Rows with digests, made for many statements of a shape at a time, against one review each."""

import numpy as np
import pyarrow as pa
import pytest

from plumbline.functions.analysis import analyze
from plumbline.functions.identity import fnv
from plumbline.operators import digests, sections, shapes
from plumbline.operators.sections import SECTIONS
from plumbline.sources.corpora import NOTES
from test_shapes import FORMS, plain

#: Strings and words beyond ASCII and the BMP, equal records whose ids are repeated, and numbers in several ids.
WIDE = ("SELECT o.é FROM orders o WHERE o.x = '{n}é{m}' AND o.ü = {n}", "SELECT '\U0001f600' AS y FROM orders o WHERE o.x IN ({m}, {n})", "SELECT o.x, o.x FROM orders o WHERE o.x = {n} AND o.x = {n} AND o.y = {m} AND o.z > {m}", "SELECT c.email, sum(c.a * {n}) FROM customer c GROUP BY c.email, c.b + {m}")
NUMBERS = [(str(n), str(m)) for n, m in zip(range(40001, 40041), [8152, 9999] * 20, strict=True)] + [("7113", "7113"), ("7114", "7114"), ("15000", "1500")]
TEXTS = [form.format(n=n, m=m) for n, m in NUMBERS for form in (FORMS[0], FORMS[1], FORMS[3], FORMS[5], *WIDE)]


def rows_of_all(name, texts):
    """Rows by statement, and how many statements had theirs made with others."""
    memory, out, together = shapes.Memory(SECTIONS[name][1]), [None] * len(texts), 0
    for e, places, values in shapes.found(memory, pa.array(texts), pa.array([NOTES] * len(texts))):
        for k, place in enumerate(np.atleast_1d(places)):
            rows, own = [list(r) for r in e.rows], [v[k].as_py() if isinstance(v, pa.Array) else v for v in values or ()]
            for i, c, cut, whole in e.holes if values is not None else ():
                rows[i][c] = shapes._filled(cut, whole, own)
            out[place], together = plain(rows), together + (values is not None and isinstance(values[0], pa.Array))
    return out, together


@pytest.mark.parametrize("name", ["export_files", "exports", "findings", "lineage_nodes", "lineage_edges", "flow_signals", "metrics", "actions"])
def test_rows_with_digests_are_those_of_each_statement(name):
    got, together = rows_of_all(name, TEXTS)
    assert got == [plain(SECTIONS[name][1](sql, NOTES)) for sql in TEXTS]
    # rows of flow_signals list ids and those of actions have another kind of hash: these are still made one by one
    assert together > len(TEXTS) // 3 or name in ("flow_signals", "actions")


def test_equal_ids_are_left_to_single_reviews(monkeypatch):
    monkeypatch.setattr(digests, "fnv_of", lambda texts, values: np.zeros(values.shape[1], np.uint64))
    texts = [x for x in TEXTS if "lower" in x]
    got, together = rows_of_all("export_files", texts)
    assert not together and got == [plain(SECTIONS["export_files"][1](sql, NOTES)) for sql in texts]


def test_documents_of_a_shape_are_put_together_once_an_order(monkeypatch):
    n = []
    monkeypatch.setattr(sections.analysis, "analyze", lambda *x: n.append(x) or analyze(*x))
    texts = [f"SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = {i}" for i in range(20000, 22000)]
    got, together = rows_of_all("export_files", texts)
    assert len(n) <= 60 and together >= 1990
    assert [len({rows[i][2] for rows in got}) for i in (0, 1)] == [2000, 2000]


def test_columns_of_digests_are_fnv():
    texts = ["ab12cd", "é€\U0001f60012", "12"]
    for text in texts:
        t = digests.Text([text.replace("12", ""), 0], [(0, 2)], digests._points)
        values = np.frombuffer(b"127799", np.uint8).reshape(3, 2).T
        assert ["".join(map(chr, x)) for x in digests.spelled(digests.fnv_of([(t, 0, 2), (t, 2, 3)], values)).T] == [fnv(text.replace("12", "") + x) for x in ("12", "77", "99")]
