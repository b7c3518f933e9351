"""What a reader sees of nodes and lines; reports, files of exports and their checks; layers, ids and lines as DataFrames."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import analysis, demo, exports, report, selection
from plumbline.operators import native, views
from plumbline.operators.sections import section
from plumbline.sources.corpora import NOTES, write_files

LONG = "WITH w AS (\n  SELECT o.o_custkey\n  FROM orders o\n)\nSELECT c.email\nFROM customer c\nJOIN w ON w.o_custkey = c.c_custkey\nWHERE c.c_name LIKE '%a'\n  AND c.c_custkey > 5"


def reader(sql, notes=NOTES):
    return selection.Reader(analysis.analyze(sql, notes))


@pytest.mark.parametrize(
    ("line", "before", "scope"),
    [
        ("SELECT a", "", "SELECT"),
        ("WITH x AS (", "", "CTE"),
        ("), y AS (", "SELECT", "CTE"),
        ("LEFT JOIN t ON a = b", "FROM", "JOIN"),
        ("FROM a JOIN b", "", "FROM"),
        ("AND c = 1", "JOIN", "JOIN"),
        ("or c = 1", "SELECT", "FILTER"),
        ("GROUP BY a", "", "GRAIN"),
        ("OFFSET 5", "", "BOUND"),
        ("  b,", "SELECT", "SELECT"),
        ("", "FROM", "SQL"),
        ("b", "", ""),
    ],
)
def test_scope_of_a_line(line, before, scope):
    assert selection.scope_of(line, before) == scope


def test_tokens_must_follow_each_other():
    assert selection.shows("WHERE a.b = 'x y' AND c", "a . b = 'x y'")
    assert not selection.shows("WHERE ab = 1", "a")
    assert not selection.shows("WHERE a AND b", "a b")
    assert not selection.shows("a", "") and not selection.shows("", "a")


def test_lens_of_many_lines():
    r = reader(LONG)
    rows = selection.lens(r)
    about = {x["text"].strip(): (x["node"], x["scope"]) for x in rows}
    assert about["SELECT c.email"] == ("projection-0", "SELECT")
    assert about["AND c.c_custkey > 5"] == ("where-1", "FILTER")
    assert next(x for x in rows if x["node"] == "where-0")["severity"] == "medium"
    node = next(n for n in r.nodes if n["legacyId"] == "where-1")
    assert [rows[i - 1]["node"] for i in selection.highlighted(rows, node)] == ["where-1"]
    assert selection.highlighted(rows, None) == []


def test_a_finding_that_names_its_line():
    rows = selection.lens(reader("SELECT a\nFROM (SELECT b\nFROM t", ""))
    assert any(x["diagnostic"] == "Opening parenthesis has no closer" and x["raw"] == 2 for x in rows)


def test_context_of_nodes():
    r = reader(LONG)
    by = {n["legacyId"]: n for n in r.nodes}
    assert r.finding(by["projection-0"])["code"] == "P2" and r.action(by["projection-0"], r.finding(by["projection-0"]))["title"].startswith("Redact")
    assert r.step(by["source-0"], loose=False) is None and r.step(by["source-0"]) is r.steps[-1]
    assert r.start()["legacyId"] == (r.node_for(r.findings[0]["evidence"]) or {"legacyId": "result-0"})["legacyId"]
    chosen = r.metrics[0]["nodeId"]
    assert selection.pinned([], r.metrics, chosen) == [r.metrics[0]] and selection.pinned(r.metrics, r.metrics, "none") == r.metrics


@pytest.mark.parametrize("sql", ["", "DELETE FROM t", "(((", "SELECT FROM", "\x00'", "SELECT 1"])
def test_any_text_has_views_and_a_report(sql):
    r = reader(sql, "")
    for view in (selection.board, selection.table, selection.evidence, selection.hotspots, selection.lens, selection.anchors):
        assert isinstance(view(r), list)
    a = analysis.analyze(sql, "")
    assert report.text(a).startswith("# SQL review report\n\n## Summary\nRisk level: ")
    assert len(report.audience(a)) == 3 and len(report.narrative(a)) >= 4
    assert exports.problems(exports.document(a, "")) == []


def test_report_of_the_demo():
    text = report.text(analysis.analyze(demo.statement(), demo.NOTES))
    assert "## Findings\n- [HIGH] Opening parenthesis has no closer" in text and "Suggestion: Close the expression." in text
    assert text.index("## Flow") < text.index("## Trace") < text.index("## Parameterized SQL")
    quoted = report.text(analysis.analyze("SELECT '```' AS a FROM orders", NOTES))
    assert "````sql\nSELECT" in quoted


def damaged(change):
    doc = copy.deepcopy(exports.document(analysis.analyze("SELECT c.email FROM customer c WHERE c.c_name = 'x'", NOTES), NOTES))
    change(doc)
    return exports.problems(doc)


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda d: d.pop("flow"), "missing: flow"),
        (lambda d: d.update(more=1), "more: unknown"),
        (lambda d: d.update(contractVersion="9"), "contractVersion: '9'"),
        (lambda d: d["state"].update(riskLevel="huge"), "state.riskLevel: 'huge'"),
        (lambda d: d["state"].update(score=float("nan")), "state.score: nan"),
        (lambda d: d["state"].update(score=True), "state.score: True"),
        (lambda d: d["findings"][0].update(title=""), "findings[0].title: ''"),
        (lambda d: d["findings"][0].pop("detail"), "findings[0].detail: missing"),
        (lambda d: d["findings"][0].update(targetIds=["b", "a"]), "findings[0].targetIds: ['b', 'a']"),
        (lambda d: d["entities"][0].update(id="source-0"), "entities[0].id: 'source-0'"),
        (lambda d: d["actions"][0].update(applied=1), "actions[0].applied: 1"),
        (lambda d: d["limitations"][0].update(code="none"), "limitations[0].code: 'none'"),
        (lambda d: d.update(routes={}), "routes: not a list"),
        (lambda d: d["metrics"].append(1), "metrics[1]: not a record"),
        (lambda d: d["input"].update(sqlDigest="0" * 16), "the input id is not the digests' digest"),
        (lambda d: d["actions"][0].update(rank=2), "rank 2 at 1"),
        (lambda d: d["state"].update(score=1), "the analysis id is not the content's digest"),
    ],
)
def test_a_document_that_is_not_valid(change, said):
    assert said in damaged(change)
    assert exports.problems(None) == ["not a record"]


def test_files_of_exports(spark, tmp_path):
    a = exports.document(analysis.analyze("SELECT 1 AS a", ""), "")
    with pytest.raises(ValueError, match="no such kind"):
        exports.artifact(a, "pdf")
    with pytest.raises(ValueError, match="missing"):
        exports.artifact({k: v for k, v in a.items() if k != "state"}, "json")
    s = spark.createDataFrame([(1, "SELECT 1 AS a"), (2, "SELECT 1 AS a"), (3, "SELECT 2 AS b")], "query_id int, sql string")
    files = section(s, "export_files")
    write_files(files, str(tmp_path / "out"))
    made = {p.name.split("=")[1]: "".join(x.read_text() for x in p.glob("part-*")) for p in (tmp_path / "out").glob("filename=*")}
    assert len(made) == 4
    name = exports.artifact(a, "json")["filename"]
    assert json.loads(made[name]) == a


def test_a_statement_that_fails_is_a_row(spark, monkeypatch):
    from plumbline.operators import sections

    monkeypatch.setattr(sections.exports, "document", lambda a, notes: {})
    (kind, ok, *_, why), _ = sections.SECTIONS["export_files"][1]("SELECT 1", "")
    assert (kind, ok) == ("json", False) and why.startswith("ValueError: missing")


def test_ids_lines_and_layers(spark):
    nodes = spark.createDataFrame([(1, "a", "x", "cte", "info", 1, 3), (1, "a", "y", "where", "high", 2, None), (1, "b", "z", "result", "info", None, None)], "query_id int, legacy_id string, node_id string, kind string, severity string, line_start int, line_end int")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "y"), (1, "q"), (2, "b")], "query_id int, target string")
    got = {(r["query_id"], r["target"]): (r["status"], r["node_id"]) for r in views.resolved(asked, nodes).collect()}
    assert got == {(1, "a"): ("ambiguous", ""), (1, "b"): ("resolved", "z"), (1, "y"): ("resolved", "y"), (1, "q"): ("unsupported", ""), (2, "b"): ("unsupported", "")}
    lines = native.raw_lines(spark.createDataFrame([(1, "p\nq\nr\ns")], "query_id int, sql string"))
    assert [r["node_id"] for r in views.line_nodes(lines, nodes).orderBy("number").collect()] == ["x", "x", "x", None]
    assert [r[0] for r in nodes.where(views.in_layer("risk")).select("node_id").orderBy("node_id").collect()] == ["y", "z"]
    assert nodes.where(views.shown(("sources", "filters"))).count() == 1 and nodes.where(views.shown()).count() == 3
    assert [r[0] for r in nodes.select(views.weight("metrics")).collect()] == [1.0, 0.68, 1.0]
    same = spark.sql("SELECT array('a', 'b') a, array('b', 'a', 'a') b, array('a') c").select(views.same_ids(F.col("a"), F.col("b")), views.same_ids(F.col("a"), F.col("c"))).first()
    assert list(same) == [True, False]


def test_neighbourhood_is_breadth_first(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (1, "d", "a"), (1, "d", "e"), (1, "e", "f"), (2, "a", "z")], "query_id int, from_id string, to_id string")
    seeds = spark.createDataFrame([(1, "a")], "query_id int, node string")
    got = {r["node"]: r["distance"] for r in native.neighbourhood(edges, seeds, 3, 24).collect()}
    assert got == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2, "f": 3}
    assert native.neighbourhood(edges, seeds, 1, 2).count() == 2
