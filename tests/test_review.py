"""Statements of the rule book, the demo model, and properties that hold for any text."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.functions import analysis, demo, exports, flow, formatting, identity, lexing, lineage, parsing, repairs
from plumbline.functions.catalog import read_notes
from plumbline.sources.corpora import NOTES

O, C = "orders o", "customer c"
CASES = [
    ("", {"D00"}, "only"),
    ("DELETE FROM orders", {"D01"}, "only"),
    (f"SELECT * FROM {O}", {"P1"}, ""),
    (f"SELECT c.email FROM {C}", {"P2"}, ""),
    (f"SELECT o.o_orderkey FROM {O} JOIN {C}", {"J1"}, ""),
    (f"SELECT o.o_orderkey FROM {O} CROSS JOIN {C}", {"J2"}, "not J1"),
    (f"SELECT c.c_name FROM {C} LEFT JOIN {O} ON o.o_custkey = c.c_custkey WHERE o.o_orderkey > 5", {"J4", "J5"}, ""),
    (f"SELECT c.c_name FROM {C} LEFT JOIN {O} ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL", {"J4"}, "not J5"),
    (f"SELECT o.o_orderkey FROM {O} WHERE o.o_custkey NOT IN (1, NULL)", {"W1", "W6", "W7"}, ""),
    (f"SELECT o.o_orderkey FROM {O} WHERE o.o_custkey = NULL", {"W2"}, ""),
    (f"SELECT c.c_name FROM {C} WHERE c.c_name LIKE '%a'", {"W4", "W6"}, ""),
    (f"SELECT c.c_name FROM {C} WHERE lower(c.c_name) = 'a'", {"W5"}, ""),
    (f"SELECT o.o_orderkey FROM {O} WHERE o.a = 1 AND o.b = 2 OR o.c = 3", {"B1", "W3"}, ""),
    (f"SELECT o.o_orderkey FROM {O} WHERE o.o_orderdate BETWEEN '2024-01-01' AND '2024-02-01'", {"W8"}, ""),
    (f"SELECT o.o_custkey, COUNT(*) FROM {O} GROUP BY o.o_orderkey", {"G1"}, "not J6"),
    (f"SELECT COUNT(*) FROM {O} JOIN {C} ON c.c_custkey = o.o_custkey", {"J6"}, ""),
    (f"SELECT o.o_orderkey FROM {O} LIMIT 10", {"O1"}, ""),
    (f"SELECT o.o_orderkey FROM {O} ORDER BY o.o_orderkey", {"O3"}, ""),
    (f"SELECT o.o_orderkey FROM {O} ORDER BY o.o_orderkey LIMIT 5 OFFSET 20", {"O2"}, ""),
    (f"SELECT row_number() OVER (PARTITION BY o.o_custkey) FROM {O}", {"N1"}, ""),
    (f"SELECT row_number() OVER (PARTITION BY f(o.a) ORDER BY o.b) FROM {O}", set(), "not N1"),
    (f"SELECT last_value(o.o_orderkey) OVER (ORDER BY o.o_orderdate) FROM {O}", {"N2"}, ""),
    (f"SELECT o.o_orderkey FROM {O}, {C}", {"F1"}, "not J2"),
    ("WITH a AS (SELECT 1 AS x FROM orders), b AS (SELECT 2 AS y FROM orders) SELECT a.x FROM a JOIN b ON a.x = b.y", set(), "not F1"),
    (f"SELECT o.o_custkey FROM {O} GROUP BY 1", {"F2", "G1"}, ""),
    (f"SELECT o.o_orderkey FROM {O} ORDER BY 1;", {"F3", "O3"}, ""),
    ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT n FROM r", {"F4"}, "not D5"),
    ("SELECT x.a FROM missing x", {"C2"}, ""),
    (f"WITH w AS (SELECT * FROM {O}) SELECT w.o_orderkey FROM w", {"C3"}, ""),
    ("SELECT a FROM t UNION SELECT a FROM u", {"D5"}, ""),
    ("SELECT a FROM t NATURAL JOIN u", {"D4", "J1"}, ""),
    ("SELECT * EXCEPT (a) FROM t", {"D6", "P1"}, ""),
    ("SELECT DISTINCT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", {"P4"}, ""),
]


@pytest.mark.parametrize(("sql", "codes", "rest"), CASES)
def test_rules(sql, codes, rest):
    found = {f["code"] for f in analysis.analyze(sql, NOTES)["diagnosis"]["findings"]}
    assert codes <= found
    if rest == "only":
        assert found == codes
    elif rest:
        assert rest.split()[1] not in found


def test_demo_model():
    sql = demo.statement()
    a = analysis.analyze(sql, demo.NOTES)
    g, f = a["diagnosis"], a["flow"]
    assert len(sql.split("\n")) == 1506
    assert [x["code"] for x in g["findings"]] == ["S4", "S9", "S5", "P3", "P3", "J1", "W6"]
    assert (g["score"], g["riskLevel"]) == (100, "high")
    assert [x["afterRows"] for x in f["steps"]] == [10_000, 100_000_000, 38_000_000]
    assert (f["maxRows"], f["blastRadius"], f["complexity"]) == (1e8, 10_000, 100)
    kinds = [n["kind"] for n in a["nodes"]]
    assert len(kinds) == 125 and kinds.count("cte") == 115
    assert len(a["metrics"]) == 232 and a["plan"]["actions"] == []
    b = analysis.extras(a, demo.NOTES)["briefing"]
    assert (b["disposition"], b["headline"]) == ("Hold", "3 high-risk issues block a clean handoff")


def test_drafts():
    draft = lambda sql: analysis.analyze(sql, NOTES)["plan"]["draftSql"]
    assert draft(f"SELECT o.o_orderkey FROM {O} WHERE o.o_custkey NOT IN (1, NULL)").endswith("o.o_custkey IS NOT NULL AND o.o_custkey NOT IN (1)")
    assert draft(f"SELECT o.o_orderkey FROM {O} ORDER BY o.o_orderkey;").endswith("\nLIMIT 500;")
    assert draft(f"SELECT c.c_name FROM {C} LEFT JOIN {O} ON o.o_custkey = c.c_custkey WHERE o.o_orderkey > 5").endswith("ON (o.o_custkey = c.c_custkey) AND (o.o_orderkey > 5) WHERE 1 = 1")


def test_lexer_keeps_strings():
    assert [t.value for t in lexing.lex("SELECT a FROM t WHERE s = 'x--y' -- z")][-1] == "'x--y'"
    assert [t.type for t in lexing.lex("[a b] \"c\"\"d\" `e` 1.5_0 x::int é")] == ["identifier"] * 3 + ["number", "word", "operator", "word", "symbol"]
    assert [t.column for t in lexing.lex("'😀' a")] == [1, 6]


def test_catalog():
    c = read_notes("-- rows: t=1_000; u=5\n-- sensitive: t.x\nCREATE TABLE t (x numeric(10,2), note text, PRIMARY KEY (x), FOREIGN KEY (note) REFERENCES u (id));\nCREATE UNIQUE INDEX i ON t (note, x);")
    t = c["tables"]["t"]
    assert list(t["columns"]) == ["x", "note"] and t["columns"]["x"]["type"] == "numeric(10,2)" and t["columns"]["x"]["sensitive"]
    assert t["rowCount"] == 1000 and t["primaryKey"] == ["x"] and t["indexes"] == [{"unique": True, "columns": ["note", "x"]}]
    assert t["foreignKeys"] == [{"column": "note", "table": "u", "columns": ["id"]}]


def test_digest_and_occurrences():
    assert identity.fnv("hello") == "a430d84680aabd0b"
    ids = [i["stableId"] for i in identity.attach([{"id": str(i), "kind": "k", "signature": {"a": 1}} for i in range(3)])]
    assert [i[-4:] for i in ids[1:]] == ["-r02", "-r03"]
    assert identity.resolve("", [])["status"] == "unsupported"


def test_limit_with_skip_and_rows_text():
    assert analysis.analyze("SELECT a FROM t LIMIT 5, 10")["flow"]["finalRows"] == 10
    assert [flow.rows_text(x) for x in (999, 1234, 95_000_000, 1_240_000)] == ["999", "1,234", "95M", "1.2M"]


def test_parameters():
    p = repairs.parameterize("SELECT 1 FROM t WHERE a = 5 AND b = 'x' GROUP BY 2")
    assert p["sql"] == "SELECT 1 FROM t WHERE a = :p1 AND b = :p2 GROUP BY 2" and [x["value"] for x in p["params"]] == ["5", "'x'"]


def test_neighbourhood_is_capped():
    nodes = analysis.analyze(demo.statement(20), demo.NOTES)["nodes"]
    result = next(n["id"] for n in nodes if n["kind"] == "result")
    assert lineage.neighbourhood(nodes, [result], 0, 9) == [result]
    assert len(lineage.neighbourhood(nodes, [result], 10, 7)) == 7


def test_canonical_json_rejects():
    for bad in (float("nan"), {1: 2}, {"a": {2}}):
        with pytest.raises(TypeError):
            exports.canonical(bad)
    assert exports.serialize({"b": 1.0, "a": [-0.0]}) == '{\n  "a": [\n    0\n  ],\n  "b": 1\n}\n'
    assert exports.safe_name("x.md", "md") and not exports.safe_name("../x.md", "md")


_texts = st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["SELECT", "FROM", "t", "JOIN", "ON", "(", ")", ",", "a.b", "=", "1", "'x", "'", "--", "/*", "\n", "GROUP BY", "ORDER BY", "LIMIT", "WITH", "AS", "UNION", "OVER", ";"]), max_size=30).map(" ".join))


@settings(max_examples=150, deadline=None)
@given(_texts)
def test_anything_is_reviewed(sql):
    a = analysis.analyze(sql, NOTES)
    x = analysis.extras(a, NOTES)
    assert exports.problems(x["document"]) == []
    assert exports.serialize(json.loads(exports.serialize(x["document"]))) == exports.serialize(x["document"])
    by = {n["id"]: n for n in a["nodes"]}
    assert all(n["id"] in by[p]["descendants"] for n in a["nodes"] for p in n["predecessors"])
    text, lines = formatting.format_sql(sql)
    assert len(lines) == (text.count("\n") + 1 if text else 0)
    assert [t.value for t in lexing.lex(lexing.without_comments(sql))] == [t.value for t in lexing.lex(sql)]
    assert parsing.parse(sql)["statementType"]


@pytest.mark.parametrize(
    ("sql", "codes"),
    [
        ("select a)\nfrom t", ["S1"]), ("select 'a\nfrom t", ["S2"]), ('select "a from t', ["S2"]), ("select a /* from t", ["S3"]), ("select ((a from t", ["S4", "S4"]),
        ("select a from t join\nwhere b = 1", []), ("select a from t join where b = 1", ["S5"]), ("select a from where b = 1", ["S6"]), ("select a from t join u on where b = 1", ["S7"]),
        ("select a,\nb from t", ["S8"]), ("select\na,\nfrom t", ["S9"]), ("select ')', \"(\" from t -- (", []),
    ],
)
def test_syntax_damage(sql, codes):
    from plumbline.functions import rules

    assert [f["code"] for f in rules.syntax_damage(sql)] == codes
