"""Rows of statements that differ in numbers, and graph views within a statement, against one review each and joins."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import exports, identity
from plumbline.functions.analysis import analyze
from plumbline.operators import graphs, native, sections, shapes, views
from plumbline.operators.sections import SECTIONS, section
from plumbline.plans import review
from plumbline.sources.corpora import NOTES

SF = "/root/testdata/sf0.001"
#: Numbers that hold each other, stand in the notes, in words, in strings, in bounds, in the analyser's own texts.
FORMS = (
    "SELECT o.a{n} FROM orders o WHERE o.o_custkey = {n} AND o.x = {m}",
    "SELECT c.email FROM customer c WHERE lower(c.c_name) = 'x{n}' AND c.z = 'it''s {m}'",
    "SELECT {n} + o.x AS y FROM orders o WHERE o.x NOT IN ({n}, {m}, NULL) ORDER BY o.x",
    "SELECT c.c_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.k = {m} WHERE o.o_totalprice > {n}",
    "SELECT * FROM orders o WHERE o.x = {n} LIMIT {m}",
    "SELECT o.x FROM orders o WHERE o.x = '{n} AND o.y = {m}",
    "SELECT o.x FROM orders o -- {n}'\nWHERE o.y = {m} AND o.z = {n}.{m}",
    "WITH w AS (SELECT o.x FROM orders o WHERE o.x = {n}) SELECT count(*) FROM w WHERE w.x BETWEEN {n} AND {m}",
)
NUMBERS = (("4711", "8152"), ("815222", "4711"), ("4711", "4711"), ("4711", "47"), ("47110", "4711"), ("1500", "15000"), ("500", "8601"), ("9999", "1234"), ("7", "77777"))
TEXTS = [form.format(n=n, m=m) for form in FORMS for n, m in NUMBERS] * 2


def plain(rows):
    return [[float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else list(v) if isinstance(v, (list, tuple)) else v for v in row] for row in rows]


def filled(rows_of, texts):
    memory = shapes.Memory(rows_of)
    out = []
    for sql in texts:
        e, values = memory.find(sql, NOTES)
        rows = [list(row) for row in e.rows]
        for i, k, cut, whole in e.holes if values is not None else ():
            rows[i][k] = shapes._filled(cut, whole, values)
        out.append(plain(rows))
    return out


@pytest.mark.parametrize("name", sorted(SECTIONS))
def test_rows_of_a_shape_are_those_of_each_statement(name):
    rows_of = SECTIONS[name][1]
    texts = TEXTS[::5] if name in ("exports", "export_files") else TEXTS
    assert filled(rows_of, texts) == [plain(rows_of(sql, NOTES)) for sql in texts]


@pytest.mark.parametrize("name", sorted(graphs.GRAPHS))
def test_views_of_a_shape_are_those_of_each_statement(name):
    view = graphs.GRAPHS[name][1]
    rows_of = lambda sql, notes: view(graphs.Graph([analyze(sql, notes)]))
    assert filled(rows_of, TEXTS) == [plain(rows_of(sql, NOTES)) for sql in TEXTS]


def by_joins(name, s):
    """The graph views as joins of nodes, edges and findings."""
    own = section(s, "lineage_nodes")
    nodes = own.withColumn("node_id", F.col("legacy_id"))
    edges = section(s, "lineage_edges").select("query_id", F.col("from_legacy").alias("from_id"), F.col("to_legacy").alias("to_id"))
    if name == "edge_risks":
        return views.edge_risks(edges, nodes)
    if name == "layer_counts":
        return views.layer_counts(nodes, edges)
    if name == "related_nodes":
        return views.related(edges, nodes.where("kind = 'projection'").select("query_id", F.col("node_id").alias("node")))
    if name == "decision_focus":
        return views.focus("decision", nodes, edges, section(s, "findings"))
    if name == "lineage_neighbourhood":
        return native.neighbourhood(edges, edges.where("to_id = 'result-0'").select("query_id", F.col("to_id").alias("node")).distinct(), 3, 24)
    asked = own.select("query_id", F.col("legacy_id").alias("target")).unionByName(own.select("query_id", F.lit("nowhere-0").alias("target")).distinct())
    return views.resolved(asked, own).select("query_id", "target", "status", (F.col("node_id") != "").alias("found"))


@pytest.mark.parametrize("name", sorted(graphs.GRAPHS))
def test_views_within_a_statement_are_those_by_joins(spark, name):
    texts = [(2**60 + i, sql) for i, sql in enumerate(TEXTS[:72:4])] + [(2**60, TEXTS[9]), (2**60 + 1, TEXTS[4]), (2**60 + 1, TEXTS[4]), (7, None), (8, "DELETE FROM t"), (None, None)]
    s = spark.createDataFrame(texts, "query_id long, sql string").withColumn("schema_text", F.lit(NOTES))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(graphs.graph(s, name)) == rows(by_joins(name, s.where("query_id IS NOT NULL")))


def test_keys_are_exact_beside_nulls(spark):
    s = spark.createDataFrame([(2**60 + 1, "SELECT 1"), (None, "SELECT 1")], "query_id long, sql string")
    assert {r["query_id"] for r in section(s, "statements").collect()} == {2**60 + 1, None}


#: Queries whose statements are reviewed once for each shape; those with graphs join nothing.
ONCE = [
    "resolved_ids",
    "edge_risks",
    "related_nodes",
    "layer_counts",
    "decision_focus",
    "lineage_neighbourhood",
    "review_actions",
    "evidence_facts",
    "report_facts",
    "review_briefings",
    "review_evidence_rows",
    "review_highlights",
    "review_inspect_board",
    "review_lens_rows",
]


def analysed(monkeypatch, run):
    n = [0]

    def counted(*args):
        n[0] += 1
        return analyze(*args)

    monkeypatch.setattr(sections.analysis, "analyze", counted)
    monkeypatch.setattr(graphs, "analyze", counted)
    run()
    return n[0]


@pytest.mark.parametrize("name", ONCE)
def test_a_shape_is_reviewed_once(spark, monkeypatch, name):
    """The query's function over 200 statements of one shape, in this process."""
    caught = []
    with monkeypatch.context() as m:
        for f in ("each", "grouped"):
            m.setattr(shapes, f, lambda batches, rows_of, schema, f=f: caught.append((f, rows_of)) or iter(()))
        m.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: f(()) and self.sparkSession.createDataFrame([], schema))
        review.QUERIES[name](spark, SF)
    ((kind, rows_of),) = caught
    alone = rows_of if kind == "each" else lambda sql, notes: rows_of([(sql, notes)])
    assert analysed(monkeypatch, lambda: filled(alone, [f"SELECT c.email FROM customer c WHERE lower(c.c_name) = 'x{i}'" for i in range(20000, 20200)])) <= 6


def test_keys_of_records_are_put_in_order_once(monkeypatch):
    n = []
    monkeypatch.setattr(exports, "_orders", {})
    monkeypatch.setattr(exports, "in_order", lambda keys: n.append(keys) or identity.in_order(keys))
    for sql in TEXTS[:20]:
        doc = exports.document(analyze(sql, NOTES), NOTES)
        assert exports.serialize(doc) == json.dumps(doc, ensure_ascii=False, indent=2) + "\n"
    assert len(n) <= 40
    with pytest.raises(TypeError, match=r"^\$\.a\[1\]\.b: not a finite number$"):
        exports.canonical({"a": [1, {"b": float("nan")}]})
    astral = {"\U0001f600": 1, "ａ": 2}
    assert list(exports.canonical(astral)) == sorted(astral, reverse=True) and identity.digest(astral) == identity.fnv('{"\U0001f600":1,"ａ":2}')


def test_both_files_come_from_one_document(monkeypatch):
    n = []
    for f in ("document", "problems"):
        whole = getattr(exports, f)
        monkeypatch.setattr(exports, f, lambda *x, f=f, whole=whole: n.append(f) or whole(*x))
    assert [ok for _, ok, *_ in SECTIONS["export_files"][1](TEXTS[0], NOTES)] == [True, True]
    assert sorted(n) == ["document", "problems"]
