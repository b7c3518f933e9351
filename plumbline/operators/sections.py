"""Analyses as DataFrames: a row for each token, clause, finding, step, node and so on of each statement.

Parsing damaged SQL is sequential within a statement, so each section is one Arrow-batched pass over
statements(query_id, sql, schema_text) that makes no more than the section needs; no section shuffles, and what follows
(counts, joins, windows) stays in Spark's own operators. Columns that aren't needed are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from plumbline.functions import analysis, exports, formatting, lexing, lineage, parsing, profile, repairs, report, selection
from plumbline.functions.catalog import read_notes
from plumbline.operators import shapes


def _tokens(sql, notes):
    tokens = lexing.lex(sql)
    return [(i, *t, d) for i, (t, d) in enumerate(zip(tokens, lexing.depths(tokens), strict=True))]


def _statement(sql, notes):
    s = parsing.parse(sql)
    return [(s["statementType"], s["unsupported"], s["distinct"], len(s["ctes"]), len(s["projections"]), len(parsing.relations(s)), len(s["joins"]), len(s["predicates"]), len(s["having"]), len(s["groupBy"]), len(s["orderBy"]), s["limit"], s["offset"], len(s["branches"]))]


def _relations(sql, notes):
    s = parsing.parse(sql)
    scopes = [("", s)] + [(c["name"], c["statement"]) for c in s["ctes"]]
    return [(scope, i, r["role"], r["type"], r["name"], r["displayName"], r["alias"]) for scope, x in scopes for i, r in enumerate(parsing.relations(x))]


def _joins(sql, notes):
    return [(j["index"], j["type"], j["source"]["name"], j["conditionKind"], j["condition"], j["implicit"], j["risky"]) for j in parsing.parse(sql)["joins"]]


def _expressions(sql, notes):
    s = parsing.parse(sql)
    parts = (("projection", "projections"), ("where", "predicates"), ("having", "having"), ("group", "groupBy"), ("order", "orderBy"))
    return [(clause, i, e["text"], e.get("alias", ""), e["aggregate"], e.get("wildcard", False), [r["text"] for r in e["references"]]) for clause, key in parts for i, e in enumerate(s[key])]


def _catalog_columns(sql, notes):
    c = read_notes(notes)
    return [(t["name"], t["rowCount"], x["name"], x["type"], x["nullable"], x["primaryKey"], x["unique"], x["sensitive"]) for t in c["tables"].values() for x in t["columns"].values()]


def _findings(sql, notes):
    return [(i, f["code"], f["severity"], f["category"], f["title"], f["evidence"], f["suggestion"], f["id"], f["stableId"]) for i, f in enumerate(analysis.analyze(sql, notes)["diagnosis"]["findings"])]


def _diagnosis(sql, notes):
    a = analysis.analyze(sql, notes)
    g, f, n = a["diagnosis"], a["flow"], a["diagnosis"]["severityCounts"]
    return [(g["score"], g["riskLevel"], *[n.get(x, 0) for x in ("high", "medium", "low", "info")], float(f["maxRows"]), float(f["finalRows"]), float(f["blastRadius"]), f["complexity"])]


def _flow(sql, notes):
    return [(i, x["phase"], x["label"], float(x["beforeRows"]), float(x["afterRows"]), float(x["change"]), x["risk"], x["evidence"]) for i, x in enumerate(analysis.analyze(sql, notes)["flow"]["steps"])]


def _nodes(sql, notes):
    return [(n["legacyId"], n["id"], n["kind"], n["label"], n["text"], n["severity"], n["lineStart"], n["lineEnd"]) for n in analysis.analyze(sql, notes)["nodes"]]


def _edges(sql, notes):
    nodes = analysis.analyze(sql, notes)["nodes"]
    legacy = {n["id"]: n["legacyId"] for n in nodes}
    return [(p, n["id"], legacy[p], n["legacyId"]) for n in nodes for p in n["predecessors"]]


def _signals(sql, notes):
    a = analysis.analyze(sql, notes)
    return [(x["id"], x["label"], x["risk"], float(x["rowDelta"]), x["targetIds"]) for x in lineage.signals(a["statement"], a["flow"], a["nodes"])]


def _actions(sql, notes):
    return [(i, x["id"], x["stableId"], x["title"], x["severity"], x["evidence"], x["targetId"], x["confidence"], float(x["rowFactor"]), x["riskDelta"], x["complexityDelta"], x["applied"], x["previewSql"]) for i, x in enumerate(analysis.analyze(sql, notes)["plan"]["actions"], 1)]


def _plan(sql, notes):
    p = analysis.analyze(sql, notes)["plan"]
    i = p["impact"]
    return [(p["draftSql"], *[float(i[k]) for k in ("beforeRisk", "afterRisk", "beforeComplexity", "afterComplexity", "beforePeakRows", "afterPeakRows", "rowsAvoided")], p["checklist"])]


def _rewrite(sql, notes):
    r = repairs.parameterize(sql or "")
    return [(r["sql"], [p["name"] for p in r["params"]], [p["value"] for p in r["params"]])]


def _formatted(sql, notes):
    text, lines = formatting.format_sql(sql)
    return [(m["formattedLine"], line, m["rawLineStart"], m["rawLineEnd"]) for m, line in zip(lines, text.split("\n"), strict=False)]


def _sources(sql, notes):
    a = analysis.analyze(sql, notes)
    keys = ("id", "role", "name", "alias", "type", "rows", "schemaStatus", "columnCount", "indexCount", "joinType", "indexedJoinKeys", "totalJoinKeys", "tone")
    return [tuple(x[k] for k in keys) for x in profile.sources(a["statement"], a["catalog"])]


def _metrics(sql, notes):
    return [(m["id"], m["stableId"], m["label"], m["expression"], m["type"], m["grain"], m["tone"], m["dependsOnIds"], [f"{s['table']}.{s['column']}" for s in m["sources"]]) for m in analysis.analyze(sql, notes)["metrics"]]


def _briefing(sql, notes):
    a = analysis.analyze(sql, notes)
    facts = [a[k] for k in ("statement", "catalog", "dialect", "diagnosis", "flow", "plan")]
    b, r = profile.briefing(*facts), profile.review(*facts, a["nodes"])
    return [(b["disposition"], b["headline"], b["readout"], b["nextActions"], b["assets"], r["grain"]["value"], r["contract"]["value"], r["criticalStep"], [f"{c['label']}: {c['value']}" for c in r["scorecards"]], r["questions"], repairs.notes(a["statement"], a["diagnosis"]["findings"], a["flow"]))]


def _chips(sql, notes):
    a = analysis.analyze(sql, notes)
    return [(i, c["label"], c["value"], c["tone"]) for i, c in enumerate(profile.chips(a["statement"], a["catalog"], a["diagnosis"], a["flow"]))]


def _exports(sql, notes):
    doc = exports.document(analysis.analyze(sql, notes), notes)
    return [(doc["analysis"]["id"], doc["input"]["id"], exports.serialize(doc), exports.markdown(doc), exports.problems(doc))]


def _reader(sql, notes):
    return selection.Reader(analysis.analyze(sql, notes))


def _rows(records):
    return [tuple(x.values()) for x in records]


def _highlights(sql, notes):
    r = _reader(sql, notes)
    lines = selection.lens(r) if r.nodes else []
    return [(n["legacyId"], line) for n in r.nodes for line in selection.highlighted(lines, n)]


def _export_files(sql, notes):
    out, doc = [], None
    for kind in exports.KINDS:
        try:
            if doc is None:
                doc = exports.document(analysis.analyze(sql, notes), notes)
                found = exports.problems(doc)
            x = exports.artifact(doc, kind, found)
            out.append((kind, True, x["filename"], x["mimeType"], x["content"], ""))
        except Exception as why:  # one statement's failure is its row's error, as in a handler, and stops no job
            out.append((kind, False, "", "", "", f"{type(why).__name__}: {why}"))
    return out


SECTIONS: dict[str, tuple[str, Callable]] = {
    "tokens": ("pos int, type string, value string, normalized string, line int, col int, depth int", _tokens),
    "statements": ("statement_type string, unsupported boolean, is_distinct boolean, ctes int, projections int, relations int, joins int, predicates int, having int, group_items int, order_items int, limit_text string, offset_text string, branches int", _statement),
    "relations": ("scope string, pos int, role string, type string, name string, display_name string, alias string", _relations),
    "joins": ("pos int, type string, source string, condition_kind string, condition string, implicit boolean, risky boolean", _joins),
    "expressions": ("clause string, pos int, text string, alias string, aggregate boolean, wildcard boolean, refs array<string>", _expressions),
    "catalog_columns": ("table_name string, row_count double, column_name string, type string, nullable boolean, primary_key boolean, is_unique boolean, sensitive boolean", _catalog_columns),
    "findings": ("pos int, code string, severity string, category string, title string, evidence string, suggestion string, legacy_id string, stable_id string", _findings),
    "diagnosis": ("score int, risk_level string, high int, medium int, low int, info int, max_rows double, final_rows double, blast_radius double, complexity int", _diagnosis),
    "flow_steps": ("pos int, phase string, label string, before_rows double, after_rows double, change double, risk string, evidence string", _flow),
    "lineage_nodes": ("legacy_id string, node_id string, kind string, label string, text string, severity string, line_start int, line_end int", _nodes),
    "lineage_edges": ("from_id string, to_id string, from_legacy string, to_legacy string", _edges),
    "flow_signals": ("signal_id string, label string, risk string, row_delta double, target_ids array<string>", _signals),
    "actions": ("rank int, action_id string, stable_id string, title string, severity string, evidence string, target_id string, confidence string, row_factor double, risk_delta int, complexity_delta int, applied boolean, preview_sql string", _actions),
    "plans": ("draft_sql string, before_risk double, after_risk double, before_complexity double, after_complexity double, before_peak_rows double, after_peak_rows double, rows_avoided double, checklist array<string>", _plan),
    "rewrites": ("rewritten string, param_names array<string>, param_values array<string>", _rewrite),
    "formatted": ("line int, text string, raw_start int, raw_end int", _formatted),
    "sources": ("source_id string, role string, name string, alias string, type string, rows double, schema_status string, column_count int, index_count int, join_type string, indexed_join_keys int, total_join_keys int, tone string", _sources),
    "metrics": ("legacy_id string, stable_id string, label string, expression string, type string, grain string, tone string, depends_on array<string>, inputs array<string>", _metrics),
    "briefings": ("disposition string, headline string, readout string, next_actions array<string>, assets array<string>, grain string, contract string, critical_step string, scorecards array<string>, questions array<string>, notes array<string>", _briefing),
    "chips": ("pos int, label string, value string, tone string", _chips),
    "inspect_board": ("node string, kind string, severity string, label string, line int, chosen boolean, n_in int, n_out int, path string, motion string, finding string, action string, metrics array<string>, sources array<string>, questions array<string>", lambda sql, notes: _rows(selection.board(_reader(sql, notes)))),
    "node_table": ("node string, kind string, severity string, sources string, metrics string, grain string, before array<string>, after array<string>, lines string", lambda sql, notes: _rows(selection.table(_reader(sql, notes)))),
    "evidence_rows": ("node string, reader string, pos int, label string, value string", lambda sql, notes: _rows(selection.evidence(_reader(sql, notes)))),
    "hotspots": ("reader string, label string, tone string, node string", lambda sql, notes: _rows(selection.hotspots(_reader(sql, notes)))),
    "lens_rows": ("line int, raw_start int, raw_end int, text string, node string, scope string, opens boolean, severity string, diagnostic string", lambda sql, notes: _rows(selection.lens(_reader(sql, notes)))),
    "lens_anchors": ("node string, scope string, label string, severity string", lambda sql, notes: _rows(selection.anchors(_reader(sql, notes)))),
    "highlights": ("node string, line int", _highlights),
    "narratives": ("label string, value string, detail string, tone string", lambda sql, notes: _rows(report.narrative(analysis.analyze(sql, notes)))),
    "audience": ("reader string, label string, detail string, tone string", lambda sql, notes: _rows(report.audience(analysis.analyze(sql, notes)))),
    "reports": ("text string", lambda sql, notes: [(report.text(analysis.analyze(sql, notes)),)]),
    "export_files": ("format string, ok boolean, filename string, mime_type string, content string, error string", _export_files),
    "exports": ("analysis_id string, input_id string, json string, markdown string, problems array<string>", _exports),
}


def section(statements: DataFrame, name: str, columns: Sequence[str] = (), only: dict[str, Collection] | None = None, joined: dict[str, str] | None = None, notes: str | None = None, read: tuple[str, Callable[[tuple], tuple]] | None = None) -> DataFrame:
    """query_id and the columns of a section (those asked for, or all) for statements(query_id, sql[, schema_text]).
    only: values that columns of a row must have, one of each; joined: lists that are returned as texts, and what stands
    between; read: columns that are worked out of a row instead; notes: the notes of all statements, instead of
    schema_text. What isn't asked for never leaves Python. Without columns of digests, statements that differ in numbers
    only are reviewed once, and rows that statements share are sent once and repeated by Spark (see shapes)."""
    ddl, whole = SECTIONS[name]
    joined = joined or {}
    kinds = dict(c.strip().split(" ") for c in ddl.split(", "))
    names = list(kinds)
    tests = [(names.index(c), values) for c, values in (only or {}).items()]
    at = [(names.index(c), joined.get(c)) for c in columns or names]
    plain = not columns and not joined

    def rows_of(sql, notes):
        rows = [row for row in whole(sql, notes) if all(row[i] in values for i, values in tests)]
        if read:
            return [read[1](row) for row in rows]
        return rows if plain else [tuple([row[i] if by is None else _listed(row[i], by) for i, by in at]) for row in rows]

    made = dict(c.strip().split(" ") for c in read[0].split(", ")) if read else {c: "string" if c in joined else kinds[c] for c in columns or names}
    part = reviewed(statements) if notes is None else statements.select("query_id", "sql")
    text = shapes.shared_type(part.schema["query_id"].dataType.simpleString(), made)
    arrow = arrow_of(text)
    return shapes.expanded(part.mapInArrow(lambda batches: shapes.each(batches if notes is None else shapes.noted(batches, notes), rows_of, arrow), text), list(made))


def _listed(values: list | None, by: str) -> str | None:
    return None if values is None else by.join([x for x in values if x is not None])


def reviewed(statements: DataFrame) -> DataFrame:
    """query_id, sql and schema_text of statements."""
    notes = F.col("schema_text") if "schema_text" in statements.columns else F.lit("")
    return statements.select("query_id", "sql", notes.alias("schema_text"))


def arrow_of(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))
