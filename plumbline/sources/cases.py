"""One small statement for each rule, with the codes of all its findings: a corpus that shows every rule at work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.corpora import NOTES

_O, _C = "SELECT o.o_orderkey FROM orders o", "SELECT c.c_name FROM customer c"

#: Statement and the codes of its findings, derived by hand from the rules' definitions; read with NOTES.
REVIEWED: tuple[tuple[str, str], ...] = (
    ("", "D00"),
    ("DELETE FROM orders", "D01"),
    ("SELECT * FROM orders o", "P1"),
    ("SELECT c.email FROM customer c", "P2"),
    (f"{_O} JOIN customer c", "J1"),
    (f"{_O} CROSS JOIN customer c", "J2"),
    (f"{_C} LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey > 5", "J4 J5 W6"),
    (f"{_C} LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL", "J4"),
    (f"{_O} WHERE o.o_custkey NOT IN (1, NULL)", "W1 W6 W7"),
    (f"{_O} WHERE o.o_custkey = NULL", "W2 W7"),
    (f"{_C} WHERE c.c_name LIKE '%a'", "W4 W6 W7"),
    (f"{_C} WHERE lower(c.c_name) = 'a'", "W5 W6 W7"),
    (f"{_O} WHERE o.o_custkey = 1 AND o.o_orderkey = 2 OR o.o_custkey = 3", "B1 W3 W6 W7"),
    (f"{_O} WHERE o.o_orderdate BETWEEN '2024-01-01' AND '2024-02-01'", "W6 W7 W8"),
    ("SELECT o.o_custkey, COUNT(*) AS n FROM orders o GROUP BY o.o_orderkey", "G1"),
    (f"SELECT COUNT(*) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey", "J4 J6"),
    (f"{_O} LIMIT 10", "O1"),
    (f"{_O} ORDER BY o.o_orderkey", "O3"),
    (f"{_O} ORDER BY o.o_orderkey LIMIT 5 OFFSET 20", "O2"),
    ("SELECT row_number() OVER (PARTITION BY o.o_custkey) AS r FROM orders o", "N1"),
    ("SELECT last_value(o.o_orderkey) OVER (ORDER BY o.o_orderdate) AS v FROM orders o", "N2"),
    ("SELECT o.o_orderkey FROM orders o, customer c", "F1"),
    ("SELECT o.o_custkey FROM orders o GROUP BY 1", "F2 G1"),
    (f"{_O} ORDER BY 1", "F3 O3"),
    ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 AS n FROM r) SELECT r.n FROM r", "F4"),
    ("SELECT x.a FROM missing x", "C2"),
    ("WITH w AS (SELECT * FROM orders o) SELECT w.o_orderkey FROM w", "C3"),
)

#: Statement and the codes of its dialect findings (D0 to D30), read without notes.
DIALECTED: tuple[tuple[str, str], ...] = (
    ("SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1", "D0 D1"),
    ("SELECT a FROM t MINUS SELECT a FROM u", ""),
    ("SELECT a::int AS b FROM t WHERE a ILIKE 'x' MINUS SELECT a FROM u", "D0 D2"),
    ("SELECT a FROM {{ ref('t') }}", "D3"),
    ("SELECT a FROM t NATURAL JOIN u", "D4"),
    ("SELECT a FROM t UNION SELECT a FROM u", "D5"),
    ("SELECT a FROM t UNION ALL SELECT a FROM u", ""),
    ("SELECT * EXCEPT (a) FROM t", "D6"),
    ("SELECT * EXCEPT (a) FROM t WHERE created_at > 1", "D6 D9"),
    ("SELECT a FROM `p.d.t` WHERE created_at > 1", "D0 D9"),
    ("SELECT a FROM `p.d.events_*`", "D0 D7"),
    ("SELECT a FROM t, LATERAL FLATTEN(input => b)", "D10"),
    ("SELECT a FROM t SAMPLE (10)", "D11"),
    ("SELECT a FROM t LATERAL VIEW explode(b) x AS y", "D12"),
    ("SELECT collect_list(a) AS c FROM t LATERAL VIEW explode(b) x AS y", "D12 D13"),
    ("SELECT a FROM t CROSS JOIN UNNEST(b) AS u(c)", "D0 D8 D14"),
    ("SELECT approx_distinct(a) AS n FROM t CROSS JOIN UNNEST(b) AS u(c)", "D0 D14 D15"),
    ("SELECT a FROM read_parquet('f') GROUP BY ALL", "D16 D17"),
    ("SELECT APPROXIMATE COUNT(DISTINCT a) AS n FROM t", "D18"),
    ("CREATE TABLE t DISTSTYLE ALL AS SELECT 1", ""),
    ("SELECT argMax(a, b) AS x FROM t FINAL", "D20"),
    ("SELECT toDateTime(a) AS x FROM t ARRAY JOIN b", "D21"),
    ("SELECT a FROM t WITH (NOLOCK)", "D22"),
    ("SELECT TOP 5 [a] FROM t WITH (NOLOCK)", "D22 D23"),
    ("SELECT DISTINCT ON (a) a FROM t", "D24"),
    ("SELECT DISTINCT ON (a) a FROM t WHERE b::date = c ORDER BY a", "D25"),
    ("SELECT SQL_CALC_FOUND_ROWS a FROM t LIMIT 5, 10", "D26 D27"),
    ("SELECT a FROM t WHERE b = c(+)", "D28"),
    ("SELECT a FROM t WHERE b = c(+) AND ROWNUM < 5 ORDER BY a", "D28 D29"),
    ("SELECT rowid, strftime(a) AS y FROM t WHERE c LIKE 'x'", "D30"),
)


def statements(spark: SparkSession, sf_dir: str, cases: tuple[tuple[str, str], ...], notes: str) -> DataFrame:
    """query_id, sql, schema_text: for every supplier the case that its key picks. There are as many rows to broadcast as cases."""
    rows = spark.createDataFrame([(i, sql) for i, (sql, _) in enumerate(cases)], "n int, sql string")
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("query_id"), F.pmod("s_suppkey", F.lit(len(cases))).cast("int").alias("n"))
    return keys.join(F.broadcast(rows), "n").select("query_id", "sql", F.lit(notes).alias("schema_text"))


def expected(cases: tuple[tuple[str, str], ...]) -> str:
    """SQL: query_id and code for every supplier, by the codes given with its case."""
    rows = ", ".join(f"({i}, '{code}')" for i, (_, codes) in enumerate(cases) for code in codes.split())
    return f"SELECT s_suppkey AS query_id, code FROM supplier JOIN (VALUES {rows}) e(n, code) ON s_suppkey % {len(cases)} = n"


#: By section: its columns, and statements (notes for the catalog) with their rows, checked by hand.
SHAPED: dict[str, tuple[tuple[str, ...], tuple[tuple[str, tuple[tuple, ...]], ...]]] = {
    "joins": (
        ("pos", "type", "source", "condition_kind", "condition", "implicit"),
        (
            ("SELECT a.x FROM a", ()),
            ("SELECT a.x FROM a INNER JOIN b ON a.x = b.x", ((0, "inner", "b", "on", "a.x = b.x", False),)),
            ("SELECT a.x FROM a RIGHT OUTER JOIN b USING (x)", ((0, "right", "b", "using", "(x)", False),)),
            ("SELECT a.x FROM a FULL JOIN b ON a.x = b.x", ((0, "full", "b", "on", "a.x = b.x", False),)),
            ("SELECT a.x FROM a CROSS JOIN b", ((0, "cross", "b", "", "", False),)),
            ("SELECT a.x FROM a NATURAL JOIN b", ((0, "natural", "b", "", "", False),)),
            ("SELECT a.x FROM a, b", ((0, "cross", "b", "", "", True),)),
            ("SELECT a.x FROM a LEFT JOIN b ON a.x = b.x JOIN s.c AS k ON k.y > b.y", ((0, "left", "b", "on", "a.x = b.x", False), (1, "inner", "s.c", "on", "k.y > b.y", False))),
            ("SELECT a.x FROM a JOIN (SELECT b.x FROM b JOIN c ON b.y = c.y) d ON d.x = a.x", ((0, "inner", "d", "on", "d.x = a.x", False),)),
        ),
    ),
    "statements": (
        ("statement_type", "unsupported", "is_distinct", "ctes", "projections", "relations", "joins", "predicates", "having", "group_items", "order_items", "limit_text", "offset_text"),
        (
            ("", (("empty", True, False, 0, 0, 0, 0, 0, 0, 0, 0, "", ""),)),
            ("INSERT INTO t VALUES (1)", (("insert", True, False, 0, 0, 0, 0, 0, 0, 0, 0, "", ""),)),
            ("SELECT DISTINCT a FROM t LIMIT 3 OFFSET 4", (("select", False, True, 0, 1, 1, 0, 0, 0, 0, 0, "3", "4"),)),
            ("WITH x AS (SELECT 1 AS a), y AS (SELECT 2 AS b) SELECT x.a FROM x, y", (("with", False, False, 2, 1, 2, 1, 0, 0, 0, 0, "", ""),)),
            ("SELECT a, f(b, c) FROM t WHERE a = 1 AND b BETWEEN 2 AND 3 AND (c = 1 OR c = 2) ORDER BY a DESC, b", (("select", False, False, 0, 2, 1, 0, 3, 0, 0, 2, "", ""),)),
            ("SELECT a, COUNT(*) AS n FROM t GROUP BY a, b HAVING COUNT(*) > 1 AND SUM(b) < 9", (("select", False, False, 0, 2, 1, 0, 0, 2, 2, 0, "", ""),)),
        ),
    ),
    "tokens": (
        ("pos", "type", "value", "normalized", "line", "col", "depth"),
        (
            ("a::int <> b", ((0, "word", "a", "a", 1, 1, 0), (1, "operator", "::", "::", 1, 2, 0), (2, "word", "int", "int", 1, 4, 0), (3, "operator", "<>", "<>", 1, 8, 0), (4, "word", "b", "b", 1, 11, 0))),
            ("F(x) -- c\n /* z */ >= 1.5", ((0, "word", "F", "f", 1, 1, 0), (1, "symbol", "(", "(", 1, 2, 1), (2, "word", "x", "x", 1, 3, 1), (3, "symbol", ")", ")", 1, 4, 0), (4, "operator", ">=", ">=", 2, 10, 0), (5, "number", "1.5", "1.5", 2, 13, 0))),
            ("'it''s', \"Q\".x", ((0, "string", "'it''s'", "'it''s'", 1, 1, 0), (1, "symbol", ",", ",", 1, 8, 0), (2, "identifier", '"Q"', '"Q"', 1, 10, 0), (3, "symbol", ".", ".", 1, 13, 0), (4, "word", "x", "x", 1, 14, 0))),
        ),
    ),
    "catalog_columns": (
        ("table_name", "row_count", "column_name", "type", "nullable", "primary_key", "is_unique", "sensitive"),
        (
            ("CREATE TABLE a (id bigint PRIMARY KEY, b_id int REFERENCES b(id), label varchar(20) NOT NULL UNIQUE);\nCREATE INDEX i ON a (b_id);\n-- sensitive: a.label", (("a", None, "id", "bigint", False, True, False, False), ("a", None, "b_id", "int", True, False, False, False), ("a", None, "label", "varchar(20)", False, False, True, True))),
            ("CREATE TABLE IF NOT EXISTS s.b (id int, v text, PRIMARY KEY (id), FOREIGN KEY (v) REFERENCES a(id));\n-- rows: s.b=2_500", (("s.b", 2500.0, "id", "int", True, True, False, False), ("s.b", 2500.0, "v", "text", True, False, False, False))),
            ("CREATE TABLE c (email text, n int);\nsensitive: n", (("c", None, "email", "text", True, False, False, True), ("c", None, "n", "int", True, False, False, True))),
            ("no table here", ()),
        ),
    ),
}


def shaped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a section for its cases, one case for each supplier."""
    from plumbline.operators.sections import section

    columns, rows = SHAPED[name]
    texts = statements(spark, sf_dir, tuple((text, "") for text, _ in rows), "")
    if name == "catalog_columns":
        texts = texts.select("query_id", F.lit("").alias("sql"), F.col("sql").alias("schema_text"))
    return section(texts, name).select("query_id", *columns)


def shaped_sql(name: str) -> str:
    columns, rows = SHAPED[name]
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    values = ", ".join("(" + ", ".join([str(i), *map(said, row)]) + ")" for i, (_, some) in enumerate(rows) for row in some)
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT s_suppkey AS query_id, {names} FROM supplier JOIN (VALUES {values}) e(n, {names}) ON s_suppkey % {len(rows)} = n"
