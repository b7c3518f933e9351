"""Statements looked up by shape many at a time, and rows that they share sent once: against one review each."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import shapes
from plumbline.operators.sections import SECTIONS, section
from plumbline.plans import review
from plumbline.sources.corpora import NOTES
from test_shapes import FORMS, NUMBERS, SF, plain

#: Each form with many numbers: equal, repeated, holding each other, in the notes, in words, beside short ones and wider text.
MORE = [(str(n), str(m)) for n, m in zip(range(4000, 4040), [8152, 4003, 15, 815222, 4712] * 8, strict=True)]
ODD = ["SELECT o.é{n} FROM orders o WHERE o.x = '{n}é{m}'", "SELECT 1, o.a{m} FROM orders o WHERE o.x = {n} AND o.z = 12 OR o.y = {m}", "SELECT o.x\r\nFROM orders o WHERE o.x = {n}"]
TEXTS = [form.format(n=n, m=m) for form in (*FORMS, *ODD) for n, m in (*NUMBERS, *MORE)] + [None, "", "DELETE FROM t", "SELECT '" + "x" * 2000 + "' FROM t WHERE a = 4711"] * 5


@pytest.mark.parametrize("name", sorted(set(SECTIONS) - {"exports", "export_files"}))
def test_rows_of_many_statements_are_those_of_each(spark, name):
    ddl, rows_of = SECTIONS[name]
    texts = TEXTS if name in ("highlights", "lens_rows", "evidence_rows", "findings", "metrics") else TEXTS[::3]
    s = spark.createDataFrame([(2**60 + i if i % 9 else None, sql, NOTES if i % 4 else None) for i, sql in enumerate(texts)], "query_id long, sql string, schema_text string").coalesce(1)
    want = [[r["query_id"], *plain([row])[0]] for r in s.collect() for row in rows_of(r["sql"] or "", r["schema_text"] or "")]
    got = [[r[0], *plain([r[1:]])[0]] for r in section(s, name).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def sent(spark, monkeypatch, name, texts):
    """What the function of a query sends of statements, its rows a statement, and those of them that hold numbers."""
    caught, made = [], []
    each = shapes.each
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: caught.append((f, self.columns)) or self.sparkSession.createDataFrame([], schema))
        m.setattr(shapes, "each", lambda batches, rows_of, schema: made.append(rows_of) or each(batches, rows_of, schema))
        review.QUERIES[name](spark, SF)
        ((f, columns),) = caught
        whole = {"query_id": pa.array(range(len(texts)), pa.int64()), "sql": pa.array(texts), "schema_text": pa.array([NOTES] * len(texts))}
        out = list(f(iter([pa.record_batch({c: whole[c] for c in columns})])))
    memory = shapes.Memory(made[0])
    e = [memory.find(x, NOTES)[0] for x in texts[:3]][-1]
    return out, len(e.rows), len({h[0] for h in e.holes}), columns


@pytest.mark.parametrize("name", ["evidence_facts", "report_facts", "review_briefings", "review_evidence_rows", "review_highlights", "review_inspect_board", "review_lens_rows"])
def test_rows_that_statements_share_are_sent_once(spark, monkeypatch, name):
    out, rows, own, columns = sent(spark, monkeypatch, name, [f"SELECT c.email FROM customer c WHERE lower(c.c_name) = 'x{i}'" for i in range(20000, 22000)])
    assert columns == ["query_id", "sql"] and own < rows + (rows == 1)
    assert sum(b.num_rows for b in out) == 2000 * own + 1 * (own < rows)


def test_what_is_not_asked_for_is_not_sent(spark, monkeypatch):
    asked = ("Handoff", "Exposure", "Grain", "Motion", "Evidence", "Diagnostic", "Path")
    out = sent(spark, monkeypatch, "evidence_facts", [FORMS[0].format(n=i, m=4711) for i in range(8000, 8100)])[0]
    assert {row["_3"] for b in out for rows in b.column("_rows").to_pylist() for row in rows or ()} <= set(asked)


def test_facts_of_reports_are_what_spark_reads_off_them(spark):
    texts = [x for x in TEXTS if x][::5] + ["SELECT a - [b\rFROM t\u0085- c", "SELECT a -- ## Flow\n- x", "## Findings\n- [\n- [", "Sources:  x"]
    s = spark.createDataFrame(list(enumerate(texts)), "query_id long, sql string").withColumn("schema_text", F.lit(NOTES))
    said = lambda p: F.regexp_extract("text", p, 1)
    under = lambda title, mark: F.regexp_count(F.regexp_extract("text", rf"(?s)## {title}\n(.*?)(\n\n|$)", 1), F.lit(mark))
    by_spark = lambda r: r.select(said("Risk level: (.*)"), said("Risk score: ([0-9]+)/100"), said("Complexity: ([0-9]+)/100"), said("Final row estimate: (.*)"), said("Sources: (.*)"), under("Findings", r"(?m)^- \["), under("Flow", "(?m)^- "))
    reports = section(s, "reports").select("text").collect()
    extra = ["## Flow\n- a\r- b\r\n- c - d\u0085- e\n", "## Findings\n- [\n- [\r\n", "Risk level: a\rb\n## Flow\n", "## Findings\n- [x\n\n- [y", "", "Sources: a b"]
    rows = [(r["text"],) for r in reports] + [(x,) for x in extra]
    want = [tuple(r) for r in by_spark(spark.createDataFrame(rows, "text string").coalesce(1)).collect()]
    assert [review._report_facts(r) for r in rows] == want
