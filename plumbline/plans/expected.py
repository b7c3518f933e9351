"""What the analyser must say of the eight statement templates, as SQL: facts of each template, read off its
analysis and looked through by hand, the rest derived from them by the model's formulas. `{n}` in a text stands for the number in a statement."""

from __future__ import annotations

from plumbline.sources.corpora import EXPECTED, ORDERS

#: Nodes: template, place in order of clauses, id, kind, label, text, severity.
NODES = """
(0, 1, 'source-0', 'source', 'FROM o', 'orders', 'info'), (0, 2, 'where-0', 'where', 'WHERE 1', 'o.o_custkey = {n}', 'low'), (0, 3, 'projection-0', 'projection', 'SELECT 1', 'o.o_orderkey', 'info'), (0, 4, 'result-0', 'result', 'RESULT', '1 projection', 'info'),
(1, 1, 'source-0', 'source', 'FROM o', 'orders', 'info'), (1, 2, 'limit-0', 'limit', 'LIMIT', '{n}', 'info'), (1, 3, 'projection-0', 'projection', 'SELECT 1', '*', 'medium'), (1, 4, 'result-0', 'result', 'RESULT', '1 projection', 'info'),
(2, 1, 'source-0', 'source', 'FROM c', 'customer', 'info'), (2, 2, 'join-source-0', 'source', 'SOURCE o', 'orders', 'info'), (2, 3, 'join-0', 'join', 'LEFT JOIN o', 'o.o_custkey = c.c_custkey', 'medium'), (2, 4, 'where-0', 'where', 'WHERE 1', 'o.o_totalprice > {n}', 'high'), (2, 5, 'projection-0', 'projection', 'SELECT 1', 'c.c_name', 'info'), (2, 6, 'result-0', 'result', 'RESULT', '1 projection', 'info'),
(3, 1, 'source-0', 'source', 'FROM o', 'orders', 'info'), (3, 2, 'group-0', 'group', 'GROUP BY 1', 'o.o_custkey', 'info'), (3, 3, 'having-0', 'having', 'HAVING 1', 'COUNT(*) > 3', 'info'), (3, 4, 'order-0', 'order', 'ORDER BY 1', 'n', 'low'), (3, 5, 'projection-0', 'projection', 'SELECT 1', 'o.o_custkey', 'info'), (3, 6, 'projection-1', 'projection', 'SELECT n', 'COUNT(*)', 'info'), (3, 7, 'result-0', 'result', 'RESULT', '2 projections', 'info'),
(4, 1, 'source-0', 'source', 'FROM o', 'orders', 'info'), (4, 2, 'where-0', 'where', 'WHERE 1', 'o.o_custkey NOT IN({n}, NULL)', 'high'), (4, 3, 'projection-0', 'projection', 'SELECT 1', 'o.o_orderkey', 'info'), (4, 4, 'result-0', 'result', 'RESULT', '1 projection', 'info'),
(5, 1, 'cte-0', 'cte', 'CTE w', 'SELECT o.o_custkey, o.o_orderkey FROM orders o', 'info'), (5, 2, 'asset-0', 'source', 'SOURCE orders', 'orders', 'info'), (5, 3, 'source-0', 'source', 'FROM w', 'w', 'info'), (5, 4, 'where-0', 'where', 'WHERE 1', 'w.o_orderkey IS NOT NULL', 'info'), (5, 5, 'projection-0', 'projection', 'SELECT 1', 'w.o_custkey', 'info'), (5, 6, 'result-0', 'result', 'RESULT', '1 projection', 'info'),
(6, 1, 'source-0', 'source', 'FROM c', 'customer', 'info'), (6, 2, 'where-0', 'where', 'WHERE 1', 'lower(c.c_name) = ''x{n}''', 'medium'), (6, 3, 'projection-0', 'projection', 'SELECT 1', 'c.email', 'high'), (6, 4, 'result-0', 'result', 'RESULT', '1 projection', 'info'),
(7, 1, 'source-0', 'source', 'FROM o', 'orders', 'info'), (7, 2, 'projection-0', 'projection', 'SELECT 1', 'o.o_orderkey', 'info'), (7, 3, 'result-0', 'result', 'RESULT', '1 projection', 'info')"""
#: Findings in order: template, place, code, node that holds the evidence (none: no node's text).
FOUND = """
(0, 0, 'W6', 'where-0'), (0, 1, 'W7', 'where-0'), (1, 0, 'P1', 'projection-0'), (1, 1, 'O1', ''), (2, 0, 'J4', 'join-0'), (2, 1, 'J5', 'where-0'), (2, 2, 'W6', 'where-0'), (3, 0, 'W6', 'having-0'), (3, 1, 'O3', 'order-0'),
(4, 0, 'W1', 'where-0'), (4, 1, 'W6', 'where-0'), (4, 2, 'W7', 'where-0'), (5, 0, 'D02', ''), (6, 0, 'P2', 'projection-0'), (6, 1, 'W5', 'where-0'), (6, 2, 'W6', 'where-0'), (6, 3, 'W7', 'where-0'), (7, 0, 'D5', '')"""
#: Row steps: template, place, phase, label, risk, rows before and after ('{n}': the number), node whose text is the evidence.
STEPS = """
(0, 0, 'from', 'orders', 'info', '0', '15000', ''), (0, 1, 'where', 'WHERE', 'info', '15000', '2100', 'where-0'), (1, 0, 'from', 'orders', 'info', '0', '15000', ''), (1, 1, 'limit', 'LIMIT', 'info', '15000', '{n}', 'limit-0'),
(2, 0, 'from', 'customer', 'info', '0', '1500', ''), (2, 1, 'join', 'LEFT orders', 'low', '1500', '1875', 'join-0'), (2, 2, 'where', 'WHERE', 'low', '1875', '713', 'where-0'),
(3, 0, 'from', 'orders', 'info', '0', '15000', ''), (3, 1, 'group', 'GROUP BY', 'low', '15000', '1350', 'group-0'), (3, 2, 'having', 'HAVING', 'low', '1350', '878', 'having-0'), (3, 3, 'order', 'ORDER BY', 'medium', '878', '878', 'order-0'),
(4, 0, 'from', 'orders', 'info', '0', '15000', ''), (4, 1, 'where', 'WHERE', 'high', '15000', '4200', 'where-0'), (5, 0, 'from', 'w', 'info', '0', '10000', ''), (5, 1, 'where', 'WHERE', 'medium', '10000', '8200', 'where-0'),
(6, 0, 'from', 'customer', 'info', '0', '1500', ''), (6, 1, 'where', 'WHERE', 'info', '1500', '210', 'where-0'), (7, 0, 'from', 'orders', 'info', '0', '15000', '')"""
#: Repairs: template, rank, title, severity, node of the evidence, confidence, row factor, risk and complexity they take, whether a draft is written.
ACTIONS = """
(1, 1, 'Name the column contract', 'medium', 'projection-0', 'medium', 1.0, 14, 4, false), (2, 1, 'Move nullable-side filter into the LEFT JOIN', 'high', 'where-0', 'high', 0.88, 24, 10, true), (2, 2, 'Confirm the join-key access path', 'medium', 'join-0', 'medium', 0.58, 12, 4, false),
(3, 1, 'Add an exploratory result bound', 'low', 'order-0', 'high', 0.72, 5, 2, true), (4, 1, 'Make the anti-filter NULL-safe', 'high', 'where-0', 'high', 1.0, 24, 9, true), (6, 1, 'Redact or justify the sensitive projection', 'high', 'projection-0', 'medium', 1.0, 26, 4, false), (6, 2, 'Make the predicate sargable', 'medium', 'where-0', 'medium', 0.7, 12, 5, false)"""
#: Clauses counted by the complexity: template, relations, joins, CTEs, conjuncts, grouped.
SHAPE = "(0, 1, 0, 0, 1, 0), (1, 1, 0, 0, 0, 0), (2, 2, 1, 0, 1, 0), (3, 1, 0, 0, 1, 1), (4, 1, 0, 0, 1, 0), (5, 1, 0, 1, 1, 0), (6, 1, 0, 0, 1, 0), (7, 1, 0, 0, 0, 0)"
#: Formatted lines: template, line, text, node that it is about, scope.
LINES = """
(0, 1, 'SELECT o.o_orderkey', 'projection-0', 'SELECT'), (0, 2, 'FROM orders o', 'source-0', 'FROM'), (0, 3, 'WHERE o.o_custkey = {n}', 'where-0', 'FILTER'), (1, 1, 'SELECT *', 'projection-0', 'SELECT'), (1, 2, 'FROM orders o', 'source-0', 'FROM'), (1, 3, 'LIMIT {n}', '', 'BOUND'),
(2, 1, 'SELECT c.c_name', 'projection-0', 'SELECT'), (2, 2, 'FROM customer c', 'source-0', 'FROM'), (2, 3, 'LEFT JOIN orders o ON o.o_custkey = c.c_custkey', 'join-0', 'JOIN'), (2, 4, 'WHERE o.o_totalprice > {n}', 'where-0', 'FILTER'),
(3, 1, 'SELECT o.o_custkey,', 'projection-0', 'SELECT'), (3, 2, '  COUNT(*) AS n', 'projection-1', 'SELECT'), (3, 3, 'FROM orders o', 'source-0', 'FROM'), (3, 4, 'GROUP BY o.o_custkey', 'group-0', 'GRAIN'), (3, 5, 'HAVING COUNT(*) > 3', 'having-0', 'HAVING'), (3, 6, 'ORDER BY n', 'order-0', 'ORDER'),
(4, 1, 'SELECT o.o_orderkey', 'projection-0', 'SELECT'), (4, 2, 'FROM orders o', 'source-0', 'FROM'), (4, 3, 'WHERE o.o_custkey NOT IN({n}, NULL)', 'where-0', 'FILTER'),
(5, 1, 'WITH w AS(SELECT o.o_custkey, o.o_orderkey FROM orders o)', 'cte-0', 'CTE'), (5, 2, 'SELECT w.o_custkey', 'projection-0', 'SELECT'), (5, 3, 'FROM w', 'source-0', 'FROM'), (5, 4, 'WHERE w.o_orderkey IS NOT NULL', 'where-0', 'FILTER'),
(6, 1, 'SELECT c.email', 'projection-0', 'SELECT'), (6, 2, 'FROM customer c', 'source-0', 'FROM'), (6, 3, 'WHERE lower(c.c_name) = ''x{n}''', 'where-0', 'FILTER'), (7, 1, 'SELECT o.o_orderkey', 'projection-0', 'SELECT'), (7, 2, 'FROM orders o UNION', 'source-0', 'FROM'), (7, 3, 'SELECT c.c_custkey', 'projection-0', 'SELECT'), (7, 4, 'FROM customer c', 'source-0', 'FROM')"""
#: Expressions: template, clause, place, text, alias, aggregate, wildcard, references.
EXPRESSIONS = """
(0, 'projection', 0, 'o.o_orderkey', '', false, false, 'o.o_orderkey'), (0, 'where', 0, 'o.o_custkey = {n}', '', false, false, 'o.o_custkey'), (1, 'projection', 0, '*', '', false, true, ''), (2, 'projection', 0, 'c.c_name', '', false, false, 'c.c_name'), (2, 'where', 0, 'o.o_totalprice > {n}', '', false, false, 'o.o_totalprice'),
(3, 'projection', 0, 'o.o_custkey', '', false, false, 'o.o_custkey'), (3, 'projection', 1, 'COUNT(*)', 'n', true, false, ''), (3, 'having', 0, 'COUNT(*) > 3', '', true, false, ''), (3, 'group', 0, 'o.o_custkey', '', false, false, 'o.o_custkey'), (3, 'order', 0, 'n', '', false, false, ''),
(4, 'projection', 0, 'o.o_orderkey', '', false, false, 'o.o_orderkey'), (4, 'where', 0, 'o.o_custkey NOT IN({n}, NULL)', '', false, false, 'o.o_custkey'), (5, 'projection', 0, 'w.o_custkey', '', false, false, 'w.o_custkey'), (5, 'where', 0, 'w.o_orderkey IS NOT NULL', '', false, false, 'w.o_orderkey'),
(6, 'projection', 0, 'c.email', '', false, false, 'c.email'), (6, 'where', 0, 'lower(c.c_name) = ''x{n}''', '', false, false, 'c.c_name'), (7, 'projection', 0, 'o.o_orderkey', '', false, false, 'o.o_orderkey')"""
#: Sources: template, place, id, role, name, alias, type, rows, status, columns, join type, indexed keys, keys, tone.
SOURCES = """
(0, 0, 'source-0', 'Base source', 'orders', 'o', 'table', 15000, 'known', 3, '', 0, 0, 'low'), (1, 0, 'source-0', 'Base source', 'orders', 'o', 'table', 15000, 'known', 3, '', 0, 0, 'low'), (2, 0, 'source-0', 'Base source', 'customer', 'c', 'table', 1500, 'known', 3, '', 0, 0, 'low'), (2, 1, 'join-0', 'LEFT join', 'orders', 'o', 'table', 15000, 'known', 3, 'left', 1, 2, 'low'),
(3, 0, 'source-0', 'Base source', 'orders', 'o', 'table', 15000, 'known', 3, '', 0, 0, 'low'), (4, 0, 'source-0', 'Base source', 'orders', 'o', 'table', 15000, 'known', 3, '', 0, 0, 'low'), (5, 0, 'asset-0', 'CTE source', 'orders', 'o', 'table', 15000, 'known', 3, '', 0, 0, 'low'), (5, 1, 'cte-0', 'CTE block', 'w', '', 'cte', 10000, 'derived', 2, '', 0, 0, 'info'), (5, 2, 'source-0', 'CTE seed', 'w', '', 'cte', 10000, 'derived', 0, '', 0, 0, 'low'),
(6, 0, 'source-0', 'Base source', 'customer', 'c', 'table', 1500, 'known', 3, '', 0, 0, 'low'), (7, 0, 'source-0', 'Base source', 'orders', 'o', 'table', 15000, 'known', 3, '', 0, 0, 'low')"""
#: Measures: template, id, label, expression, type, grain, tone, what it depends on, its columns.
METRICS = """
(0, 'projection-0', 'o.o_orderkey', 'o.o_orderkey', 'Result field', 'o.o_orderkey', 'info', 'source-0', 'orders.o_orderkey'), (1, 'projection-0', '*', '*', 'Wildcard field set', 'projection-driven', 'medium', '', ''), (2, 'projection-0', 'c.c_name', 'c.c_name', 'Result field', 'c.c_name', 'info', 'source-0', 'customer.c_name'), (3, 'projection-1', 'n', 'COUNT(*)', 'Aggregate metric', 'o.o_custkey', 'low', '', ''),
(4, 'projection-0', 'o.o_orderkey', 'o.o_orderkey', 'Result field', 'o.o_orderkey', 'info', 'source-0', 'orders.o_orderkey'), (5, 'projection-0', 'w.o_custkey', 'w.o_custkey', 'Result field', 'w.o_custkey', 'info', 'source-0', 'w.o_custkey'), (6, 'projection-0', 'c.email', 'c.email', 'Result field', 'c.email', 'info', 'source-0', 'customer.email'), (7, 'projection-0', 'o.o_orderkey', 'o.o_orderkey', 'Result field', 'o.o_orderkey', 'info', 'source-0', 'orders.o_orderkey')"""
#: Words of the briefing: template, grain, contract, assets, questions, notes.
BRIEFS = """
(0, 'Rows', 'Explicit', 'orders', 'Which engine will run this?', 'Runtime plan still matters'), (1, 'Unknown', 'Sensitive', 'orders', 'Who approves the sensitive output?|Which engine will run this?', 'Name the result contract'), (2, 'Rows', 'Explicit', 'customer|orders', 'Is the grain really c.c_name?|Which engine will run this?', 'Preserve outer-join intent'),
(3, '1 key', 'Explicit', 'orders', 'Which engine will run this?', 'Bound exploratory sorts'), (4, 'Rows', 'Explicit', 'orders', 'Which engine will run this?', 'Avoid null-sensitive anti-joins'), (5, 'Rows', 'Explicit', 'w', 'Which engine will run this?', 'Runtime plan still matters'), (6, 'Rows', 'Sensitive', 'customer', 'Who approves the sensitive output?|Which engine will run this?', 'Runtime plan still matters'), (7, 'Rows', 'Explicit', 'orders', 'Which engine will run this?', 'Runtime plan still matters')"""

_RANK = "CASE {} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_UP = "CAST(floor({} + 0.5) AS BIGINT)"


def facts(edges: str) -> str:
    """Common table expressions: s (statements, with n), and by template and number the facts above and what follows from them."""
    put = "replace({}, '{{n}}', n)"
    return f"""WITH s AS (SELECT *, regexp_extract(sql, '([0-9]+)', 1) AS n FROM ({ORDERS})),
    k AS (SELECT DISTINCT template, CASE WHEN template IN (3, 5, 7) THEN '' ELSE n END AS n FROM s),
    st AS (SELECT s.query_id, s.sql, s.template, CASE WHEN s.template IN (3, 5, 7) THEN '' ELSE s.n END AS n FROM s),
    nd AS (SELECT st.query_id, st.template, v.i, v.node, v.kind, v.label, {put.format('v.text')} AS text, v.severity FROM st JOIN (VALUES {NODES}) v(template, i, node, kind, label, text, severity) USING (template)),
    ed AS (SELECT st.query_id, st.template, v.a, v.b FROM st JOIN (VALUES {edges}) v(template, a, b) USING (template)),
    ex AS (SELECT * FROM (VALUES {EXPECTED}) v(template, code, severity, title)),
    fd AS (SELECT st.query_id, st.template, v.pos, v.code, v.node, ex.severity, ex.title, nd.text AS evidence FROM st JOIN (VALUES {FOUND}) v(template, pos, code, node) USING (template) JOIN ex USING (template, code) LEFT JOIN nd ON nd.query_id = st.query_id AND nd.node = v.node),
    sp AS (SELECT st.query_id, st.template, v.pos, v.phase, v.label, v.risk, CAST({put.format('v.b')} AS DOUBLE) AS before, CAST({put.format('v.a')} AS DOUBLE) AS after, v.node FROM st JOIN (VALUES {STEPS}) v(template, pos, phase, label, risk, b, a, node) USING (template)),
    ac AS (SELECT st.query_id, st.template, v.rank, v.title, v.severity, v.node, v.confidence, CAST(v.f AS DOUBLE) AS f, v.risk, v.load, v.draft FROM st JOIN (VALUES {ACTIONS}) v(template, rank, title, severity, node, confidence, f, risk, load, draft) USING (template)),
    sc AS (SELECT query_id, template, least(100, sum(CASE severity WHEN 'high' THEN 30 WHEN 'medium' THEN 14 WHEN 'low' THEN 6 ELSE 2 END)) AS score, count(*) AS findings, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM fd GROUP BY ALL),
    fl AS (SELECT query_id, max(after) AS peak, arg_max(after, pos) AS final, arg_min(after, pos) AS first FROM sp GROUP BY 1),
    co AS (SELECT sc.*, fl.* EXCLUDE (query_id), z.relations, CASE WHEN score >= 60 THEN 'high' WHEN score >= 28 THEN 'medium' WHEN score >= 8 THEN 'low' ELSE 'info' END AS level, peak / first AS blast,
        {_UP.format("least(100, 12 + 10 * joins + 5 * ctes + 3 * conjuncts + 8 * grouped + 0.32 * score + least(25, 9 * log10(greatest(1, peak / first))))")} AS load
        FROM sc JOIN fl USING (query_id) JOIN (VALUES {SHAPE}) z(template, relations, joins, ctes, conjuncts, grouped) USING (template)),
    im AS (SELECT query_id, sum(risk) AS risk, sum(load) AS less, product(f) AS f, count(*) FILTER (NOT draft) AS manual, string_agg(title, '; ' ORDER BY rank) AS titles, count(*) AS n FROM ac GROUP BY 1),
    pl AS (SELECT co.*, coalesce(im.n, 0) AS actions, im.titles, greatest(CASE WHEN manual > 0 THEN 18 ELSE 0 END, score - {_UP.format('0.72 * coalesce(risk, 0)')}) AS score_after, greatest(0, load - {_UP.format('0.72 * coalesce(less, 0)')}) AS load_after, greatest(final, floor(peak * greatest(0.18, coalesce(f, 1)) + 0.5)) AS peak_after FROM co LEFT JOIN im USING (query_id)),
    ln AS (SELECT st.query_id, st.template, v.line, {put.format('v.text')} AS text, v.node, v.scope FROM st JOIN (VALUES {LINES}) v(template, line, text, node, scope) USING (template)),
    sr AS (SELECT st.query_id, v.* FROM st JOIN (VALUES {SOURCES}) v(template, pos, id, role, name, alias, type, rows, status, columns, join_type, hit, keys, tone) USING (template)),
    me AS (SELECT st.query_id, v.* FROM st JOIN (VALUES {METRICS}) v(template, id, label, expression, type, grain, tone, depends, inputs) USING (template)),
    br AS (SELECT st.query_id, v.* EXCLUDE (template) FROM st JOIN (VALUES {BRIEFS}) v(template, grain, contract, assets, questions, notes) USING (template)),
    cr AS (SELECT query_id, arg_max(label, [abs(log10(greatest(CASE WHEN before > 0 THEN after / before ELSE 1 END, 0.01))), -pos]) AS label FROM sp GROUP BY 1),
    to_n AS (SELECT st.query_id, fd.title, fd.severity, fd.node FROM st JOIN fd ON fd.query_id = st.query_id AND fd.pos = 0),
    cf AS (SELECT nd.query_id, nd.node, fd.pos, fd.title, fd.severity, fd.evidence, row_number() OVER (PARTITION BY nd.query_id, nd.node ORDER BY CASE WHEN lower(fd.evidence) = lower(nd.text) THEN 0 ELSE 1 END, fd.pos) AS i
        FROM nd JOIN fd USING (query_id) WHERE lower(fd.evidence) = lower(nd.text) OR nd.kind = 'result' OR (least(length(nd.text), length(fd.evidence)) >= 4 AND (contains(lower(fd.evidence), lower(nd.text)) OR contains(lower(nd.text), lower(fd.evidence))))),
    ca AS (SELECT nd.query_id, nd.node, nd.kind, f.title AS finding, f.severity AS finding_severity, coalesce(e.title, CASE WHEN f.title IS NULL OR f.severity = 'info' THEN coalesce(o.title, CASE WHEN nd.kind = 'result' THEN t.title END) END) AS action
        FROM nd LEFT JOIN cf f ON f.query_id = nd.query_id AND f.node = nd.node AND f.i = 1
        LEFT JOIN (SELECT ac.query_id, ac.title, nd.text, row_number() OVER (PARTITION BY ac.query_id, nd.text ORDER BY ac.rank) AS j FROM ac JOIN nd USING (query_id, node)) e ON e.query_id = nd.query_id AND e.text = f.evidence AND e.j = 1
        LEFT JOIN (SELECT query_id, node, min_by(title, rank) AS title FROM ac GROUP BY ALL) o ON o.query_id = nd.query_id AND o.node = nd.node LEFT JOIN ac t ON t.query_id = nd.query_id AND t.rank = 1),
    cs AS (SELECT nd.query_id, nd.node, coalesce(t.pos, p.pos) AS pos, l.last FROM nd
        LEFT JOIN (SELECT sp.query_id, sp.pos, nd.text FROM sp JOIN nd USING (query_id, node)) t ON t.query_id = nd.query_id AND lower(t.text) = lower(nd.text)
        LEFT JOIN sp p ON p.query_id = nd.query_id AND p.phase = nd.kind JOIN (SELECT query_id, max(pos) AS last FROM sp GROUP BY 1) l ON l.query_id = nd.query_id)"""


def _moved(step: str) -> str:
    return f"format('{{:,}}', CAST({step}.before AS BIGINT)) || ' -> ' || format('{{:,}}', CAST({step}.after AS BIGINT))"


def queries(edges: str) -> dict[str, str]:
    """SQL by query; edges has template, from and to of every lineage edge."""
    w, rank = facts(edges), _RANK.format
    level = lambda x: f"CASE {x} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END"
    near = "(SELECT query_id, a AS node, b AS other FROM ed UNION SELECT query_id, b, a FROM ed)"
    return {
        "review_expressions": f"{w} SELECT query_id, clause, pos, replace(text, '{{n}}', n) AS text, alias, aggregate, wildcard, refs FROM st JOIN (VALUES {EXPRESSIONS}) v(template, clause, pos, text, alias, aggregate, wildcard, refs) USING (template)",
        "review_lineage_nodes": f"{w} SELECT query_id, node AS legacy_id, kind, label, text, severity, CAST(CASE WHEN kind IN ('result', 'limit') THEN 0 ELSE 1 END AS INT) AS line FROM nd",
        "review_flow_signals": f"{w} SELECT query_id, 'signal-' || pos AS signal_id, label, risk, round(CASE WHEN before > 0 THEN after / before ELSE 1 END, 9) AS row_delta, 1 AS targets FROM sp",
        "review_actions": f"""{w} SELECT ac.query_id, rank, title, ac.severity, nd.text AS evidence, confidence, f AS row_factor, risk AS risk_delta, ac.load AS complexity_delta, draft AS applied,
            CASE WHEN NOT draft THEN sql WHEN ac.template = 3 THEN sql || chr(10) || 'LIMIT 500' WHEN ac.template = 4 THEN replace(replace(sql, 'NOT IN', 'IS NOT NULL AND o.o_custkey NOT IN'), ', NULL', '')
            ELSE replace(replace(sql, 'ON o.o_custkey = c.c_custkey WHERE o.o_totalprice', 'ON (o.o_custkey = c.c_custkey) AND (o.o_totalprice'), '> ' || n, '> ' || n || ') WHERE 1 = 1') END AS preview_sql FROM ac JOIN nd USING (query_id, node) JOIN st USING (query_id)""",
        "review_plans": f"{w} SELECT query_id, CAST(score AS DOUBLE) AS before_risk, CAST(score_after AS DOUBLE) AS after_risk, CAST(load AS DOUBLE) AS before_complexity, CAST(load_after AS DOUBLE) AS after_complexity, peak AS before_peak_rows, peak_after AS after_peak_rows, peak - peak_after AS rows_avoided, coalesce(titles, 'Compare the estimates with the engine''s plan.') AS checklist FROM pl",
        "review_chips": f"""{w} SELECT query_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pos, unnest(['Risk', 'Findings', 'Sources', 'Complexity', 'Schema', 'Peak Rows', 'Final Rows', 'Blast']) AS label,
            unnest([level, CAST(findings AS VARCHAR), CAST(relations AS VARCHAR), load || '/100', '2', format('{{:,}}', CAST(peak AS BIGINT)), format('{{:,}}', CAST(final AS BIGINT)), format('{{:.1f}}x', floor(blast * 10 + 0.5) / 10)]) AS value,
            unnest([level, CASE WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END, CASE WHEN relations > 5 THEN 'medium' ELSE 'info' END, CASE WHEN load >= 70 THEN 'high' WHEN load >= 42 THEN 'medium' ELSE 'low' END, 'low', CASE WHEN blast >= 10 THEN 'high' WHEN blast >= 3 THEN 'medium' ELSE 'low' END, 'info', CASE WHEN blast >= 10 THEN 'high' WHEN blast >= 3 THEN 'medium' ELSE 'low' END]) AS tone FROM co""",
        "review_sources": f"{w} SELECT query_id, id AS source_id, role, name, alias, type, CAST(rows AS DOUBLE) AS rows, status AS schema_status, columns AS column_count, 0 AS index_count, join_type, hit AS indexed_join_keys, keys AS total_join_keys, tone FROM sr",
        "review_metrics": f"{w} SELECT query_id, id AS legacy_id, label, expression, type, grain, tone, depends AS depends_on, inputs FROM me",
        "review_formatted": f"{w} SELECT query_id, line, text, 1 AS raw_start, 1 AS raw_end FROM ln",
        "review_briefings": f"""{w} SELECT pl.query_id, CASE WHEN high > 0 THEN 'Hold' WHEN medium > 0 THEN 'Review' ELSE 'Ready' END AS disposition,
            CASE WHEN high > 0 THEN high || ' high-risk issue' || CASE WHEN high > 1 THEN 's' ELSE '' END || ' block a clean handoff' WHEN medium > 0 THEN medium || ' medium-risk issue' || CASE WHEN medium > 1 THEN 's' ELSE '' END || ' need owner review' ELSE 'No blocking static hazards detected' END AS headline,
            t.title || '.' AS readout, coalesce(replace(titles, '; ', '|'), '') AS next_actions, assets, br.grain, br.contract, cr.label AS critical_step,
            'Decision: ' || CASE WHEN high > 0 THEN 'Hold' WHEN medium > 0 THEN 'Review' ELSE 'Ready' END || '|Motion: ' || format('{{:,}}', CAST(peak AS BIGINT)) || ' peak|Grain: ' || br.grain || '|Contract: ' || br.contract || '|Fix: ' || CASE WHEN actions > 0 THEN score || '->' || score_after ELSE 'Validate' END AS scorecards, questions, notes
            FROM pl JOIN br USING (query_id) JOIN cr USING (query_id) JOIN (SELECT query_id, arg_min(title, [CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pos]) AS title FROM fd GROUP BY 1) t USING (query_id)""",
        "edge_risks": f"{w} SELECT ed.query_id, a AS from_id, b AS to_id, {level(f'greatest({rank('x.severity')}, {rank('y.severity')})')} AS risk FROM ed JOIN nd x ON x.query_id = ed.query_id AND x.node = a JOIN nd y ON y.query_id = ed.query_id AND y.node = b",
        "layer_counts": f"""{w}, e AS (SELECT ed.query_id, x.kind AS k, y.kind AS l, greatest({rank('x.severity')}, {rank('y.severity')}) AS r FROM ed JOIN nd x ON x.query_id = ed.query_id AND x.node = a JOIN nd y ON y.query_id = ed.query_id AND y.node = b),
            g AS (SELECT query_id, count(*) FILTER (r >= 2) AS risk, count(*) FILTER (k IN ('group', 'having', 'projection', 'result') OR l IN ('group', 'having', 'projection', 'result')) AS grain, count(*) FILTER (k IN ('source', 'join', 'projection', 'result') OR l IN ('source', 'join', 'projection', 'result')) AS metrics, count(*) AS lineage FROM e GROUP BY 1),
            h AS (SELECT query_id, count(*) FILTER (severity IN ('high', 'medium') OR kind = 'result') AS risk, count(*) FILTER (kind IN ('group', 'having', 'projection', 'result')) AS grain, count(*) FILTER (kind IN ('source', 'join', 'projection', 'result')) AS metrics, count(*) AS lineage FROM nd GROUP BY 1)
            SELECT h.query_id, unnest(['risk', 'grain', 'metrics', 'lineage']) AS layer, unnest([h.risk, h.grain, h.metrics, h.lineage]) AS nodes, unnest([g.risk, g.grain, g.metrics, g.lineage]) AS edges FROM h JOIN g USING (query_id)""",
        "visible_counts": f"""{w}, f(hidden, kinds) AS (VALUES ('sources', ['source', 'cte']), ('joins', ['join']), ('filters', ['where', 'having']), ('grain', ['group', 'order', 'limit']), ('select', ['projection']))
            SELECT query_id, hidden, count(*) AS visible, CAST(round(sum(CASE WHEN kind = 'result' OR severity = 'high' THEN 1.0 WHEN severity = 'medium' OR kind IN ('join', 'group', 'having') THEN 0.7 ELSE 0.28 END), 2) AS DOUBLE) AS weight FROM nd, f WHERE NOT list_contains(kinds, kind) GROUP BY ALL""",
        "line_nodes": f"{w} SELECT query_id, 1 AS number, 0 AS start, CAST(length(sql) AS INT) AS \"end\", CASE template WHEN 5 THEN 'cte-0' WHEN 2 THEN 'join-source-0' ELSE 'source-0' END AS node_id FROM st",
        "resolved_ids": f"{w} SELECT query_id, node AS target, 'resolved' AS status, true AS found FROM nd UNION ALL SELECT query_id, 'nowhere-0', 'unsupported', false FROM st",
        "decision_focus": f"""{w.replace('WITH s AS', 'WITH RECURSIVE s AS', 1)}, sd AS (SELECT query_id, 'result-0' AS node FROM st UNION SELECT query_id, node FROM fd WHERE severity IN ('high', 'medium') AND node <> ''), nr AS {near},
            r(query_id, node, distance) AS (SELECT query_id, node, 0 FROM sd UNION SELECT nr.query_id, nr.other, r.distance + 1 FROM r JOIN nr ON nr.query_id = r.query_id AND nr.node = r.node WHERE r.distance < 10)
            SELECT query_id, node, CAST(min(distance) AS INT) AS distance FROM r GROUP BY ALL""",
        "stage_routes": f"{w} SELECT query_id, 0 AS route, CAST(1 AS BIGINT) AS nodes, 1 AS from_line, 1 AS to_line FROM st WHERE template = 5",
        "query_lens": f"{w} SELECT ln.query_id, ln.line, ln.text, nd.node AS node_id, nd.kind, nd.severity, CAST(row_number() OVER (PARTITION BY ln.query_id, ln.line ORDER BY nd.node) AS INT) AS rank FROM ln JOIN nd USING (query_id) WHERE nd.kind NOT IN ('result', 'limit')",
        "review_lens_rows": f"""{w} SELECT ln.query_id, line, 1 AS raw_start, 1 AS raw_end, ln.text, ln.node, scope, coalesce(scope <> lag(scope) OVER (PARTITION BY ln.query_id ORDER BY line), true) AS opens, coalesce(nd.severity, 'info') AS severity, coalesce(d.title, '') AS diagnostic
            FROM ln LEFT JOIN nd ON nd.query_id = ln.query_id AND nd.node = ln.node LEFT JOIN (SELECT query_id, node, min_by(title, pos) AS title FROM fd GROUP BY ALL) d ON d.query_id = ln.query_id AND d.node = ln.node AND ln.node <> ''""",
        "review_lens_anchors": f"""{w} SELECT query_id, node, scope, regexp_replace(label, '^(SELECT|WHERE|GROUP BY|ORDER BY)\\s*', '') AS label, severity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY i) AS j,
            CASE kind WHEN 'cte' THEN 'CTE' WHEN 'source' THEN 'FROM' WHEN 'join' THEN 'JOIN' WHEN 'where' THEN 'FILTER' WHEN 'group' THEN 'GRAIN' WHEN 'having' THEN 'HAVING' WHEN 'projection' THEN 'SELECT' WHEN 'order' THEN 'ORDER' ELSE 'BOUND' END AS scope FROM nd WHERE kind <> 'result') WHERE j <= CASE kind WHEN 'projection' THEN 4 ELSE 3 END""",
        "review_highlights": f"{w} SELECT query_id, node, line FROM ln WHERE node <> '' UNION ALL SELECT nd.query_id, nd.node, 1 FROM nd LEFT JOIN ln USING (query_id, node) WHERE ln.line IS NULL AND nd.kind NOT IN ('result', 'limit')",
        "review_inspect_board": f"""{w}, ia AS (SELECT query_id, b AS node, count(*) AS n FROM ed GROUP BY ALL), oa AS (SELECT query_id, a AS node, count(*) AS n FROM ed GROUP BY ALL)
            SELECT nd.query_id, nd.node, nd.kind, nd.severity, nd.label, nd.node = CASE WHEN t.node = '' THEN 'result-0' ELSE t.node END AS chosen, CAST(coalesce(ia.n, 0) AS INT) AS n_in, CAST(coalesce(oa.n, 0) AS INT) AS n_out, {_moved('sp')} AS motion, coalesce(ca.finding, '') AS finding, coalesce(ca.action, '') AS action, br.questions
            FROM nd JOIN ca USING (query_id, node) JOIN cs USING (query_id, node) JOIN sp ON sp.query_id = nd.query_id AND sp.pos = coalesce(cs.pos, cs.last) JOIN br ON br.query_id = nd.query_id JOIN to_n t ON t.query_id = nd.query_id LEFT JOIN ia ON ia.query_id = nd.query_id AND ia.node = nd.node LEFT JOIN oa ON oa.query_id = nd.query_id AND oa.node = nd.node""",
        "review_node_table": f"""{w}, nr AS {near}, mt AS (SELECT query_id, nd.node, string_agg(me.label, ', ') AS metrics, string_agg(me.depends, ',') AS depends FROM nd JOIN me USING (query_id) WHERE me.id = nd.node OR me.depends = nd.node GROUP BY ALL),
            so AS (SELECT nd.query_id, nd.node, string_agg(CASE WHEN sr.alias = '' THEN sr.name ELSE sr.name || ' as ' || sr.alias END, ', ' ORDER BY sr.pos) AS sources FROM nd JOIN sr USING (query_id) LEFT JOIN mt ON mt.query_id = nd.query_id AND mt.node = nd.node WHERE sr.id = nd.node OR sr.id = mt.depends OR EXISTS (SELECT 1 FROM nr WHERE nr.query_id = nd.query_id AND nr.node = nd.node AND nr.other = sr.id) GROUP BY ALL),
            lb AS (SELECT nr.query_id, ed.b IS NOT NULL AS inward, nr.node, x.label FROM nr JOIN nd x ON x.query_id = nr.query_id AND x.node = nr.other LEFT JOIN ed ON ed.query_id = nr.query_id AND ed.b = nr.node AND ed.a = nr.other)
            SELECT nd.query_id, nd.node, nd.kind, nd.severity, coalesce(so.sources, CASE WHEN nd.kind IN ('source', 'cte') THEN nd.text ELSE '' END) AS sources, coalesce(mt.metrics, '') AS metrics, CASE WHEN mt.metrics IS NOT NULL OR nd.kind IN ('group', 'having', 'projection', 'result') THEN g.grain ELSE '' END AS grain,
            coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM lb WHERE lb.query_id = nd.query_id AND lb.node = nd.node AND inward), '') AS before, coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM lb WHERE lb.query_id = nd.query_id AND lb.node = nd.node AND NOT inward), '') AS after, CASE WHEN nd.kind IN ('result', 'limit') THEN '' ELSE '1-1' END AS lines
            FROM nd LEFT JOIN so USING (query_id, node) LEFT JOIN mt USING (query_id, node) JOIN (SELECT query_id, min(grain) AS grain FROM me GROUP BY 1) g ON g.query_id = nd.query_id""",
        "review_hotspots": f"""{w}, m AS (SELECT query_id, id, tone, CASE WHEN expression = 'c.email' THEN 'Sensitive input.' ELSE 'Static inputs.' END AS risk FROM me), d AS (SELECT query_id, arg_min(struct_pack(t := title, s := severity, n := node), [CASE WHEN severity = 'high' THEN 0 ELSE 1 END, pos]) AS x FROM fd GROUP BY 1),
            c AS (SELECT query_id, arg_min(struct_pack(t := title, s := severity, n := node), pos) AS x FROM fd WHERE regexp_matches(title, '(?i)count|distinct|grain|group|window|projection|aggregate') GROUP BY 1)
            SELECT query_id, 'decision' AS reader, title AS label, severity AS tone, node FROM to_n UNION ALL SELECT query_id, 'debug', x.t, x.s, x.n FROM d UNION ALL SELECT m.query_id, 'metrics', coalesce(c.x.t, risk), coalesce(c.x.s, tone), coalesce(c.x.n, id) FROM m LEFT JOIN c USING (query_id)""",
        "evidence_facts": f"""{w}, x AS (SELECT nd.query_id, nd.node, nd.kind, ca.finding, ca.finding_severity, ca.action, br.grain, br.contract, g.grain AS level, pl.peak, CASE WHEN high > 0 THEN 'Hold' WHEN medium > 0 THEN 'Review' ELSE 'Ready' END AS posture, cs.pos, cs.last FROM nd JOIN ca USING (query_id, node) JOIN cs USING (query_id, node) JOIN br ON br.query_id = nd.query_id JOIN pl ON pl.query_id = nd.query_id JOIN (SELECT query_id, min(grain) AS grain FROM me GROUP BY 1) g ON g.query_id = nd.query_id)
            SELECT x.query_id, node, 'decision' AS reader, 0 AS pos, 'Handoff' AS label, CASE WHEN finding_severity = 'high' THEN 'Blocks handoff' WHEN finding IS NOT NULL THEN 'Needs review' ELSE posture END AS value FROM x
            UNION ALL SELECT query_id, node, 'decision', 1, 'Exposure', contract || ' / ' || format('{{:,}}', CAST(peak AS BIGINT)) || ' peak' FROM x UNION ALL SELECT query_id, node, 'metrics', 1, 'Grain', level FROM x
            UNION ALL SELECT x.query_id, x.node, 'metrics', 3, 'Motion', coalesce({_moved('sp')}, 'No row step') FROM x LEFT JOIN sp ON sp.query_id = x.query_id AND sp.pos = coalesce(x.pos, CASE WHEN x.kind = 'result' THEN x.last END)
            UNION ALL SELECT query_id, node, 'debug', 0, 'Evidence', CASE WHEN kind IN ('result', 'limit') THEN kind ELSE 'Line 1' END FROM x UNION ALL SELECT query_id, node, 'debug', 1, 'Diagnostic', coalesce(finding, '') FROM x
            UNION ALL SELECT x.query_id, x.node, 'debug', 2, 'Path', (SELECT count(*) FROM ed WHERE ed.query_id = x.query_id AND ed.b = x.node) || ' in / ' || (SELECT count(*) FROM ed WHERE ed.query_id = x.query_id AND ed.a = x.node) || ' out' FROM x""",
        "review_audience": f"""{w} SELECT pl.query_id, unnest(['manager', 'analyst', 'engineer']) AS reader, unnest([CASE WHEN high > 0 THEN 'Hold' WHEN score >= 25 THEN 'Review' ELSE 'Ready' END, '1 metric', CASE WHEN pl.template = 7 THEN 'ANSI-ish' ELSE 'ANSI-ish' END || ' / ' || format('{{:,}}', CAST(peak AS BIGINT)) || ' peak']) AS label FROM pl""",
        "export_files": f"{w} SELECT query_id, unnest(['json', 'markdown']) AS format, true AS ok, true AS named, unnest(['application/json;charset=utf-8', 'text/markdown;charset=utf-8']) AS mime_type, '' AS error, unnest([CAST(score AS VARCHAR), '']) AS score, unnest([level, '']) AS risk_level, true AS whole FROM co",
        "report_facts": f"{w} SELECT query_id, level, CAST(score AS VARCHAR) AS score, CAST(load AS VARCHAR) AS complexity, format('{{:,}}', CAST(final AS BIGINT)) AS final_rows, replace(assets, '|', ', ') AS sources, CAST(findings AS INT) AS findings, CAST((SELECT count(*) FROM sp WHERE sp.query_id = co.query_id) AS INT) AS steps FROM co JOIN br USING (query_id)",
    }
