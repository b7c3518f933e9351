"""One statement in, everything out. Plain Python; the Spark operators call it once a row."""

from __future__ import annotations

from plumbline.functions import dialects, exports, flow, formatting, lineage, profile, repairs, rules
from plumbline.functions.catalog import read_notes
from plumbline.functions.parsing import parse

#: Notes are shared by many statements; a worker keeps this many catalogs.
KEPT = 256
_catalogs: dict[str, dict] = {}


def _catalog(notes: str) -> dict:
    if notes not in _catalogs:
        if len(_catalogs) >= KEPT:
            _catalogs.clear()
        _catalogs[notes] = read_notes(notes)
    return _catalogs[notes]


#: What each part of an analysis is made from; a part that isn't asked for is never worked out.
PARTS = {
    "statement": lambda a: parse(a["sql"]),
    "catalog": lambda a: _catalog(a["notes"] or ""),
    "dialect": lambda a: dialects.detect(a["sql"]),
    "diagnosis": lambda a: rules.diagnose(a["statement"], a["catalog"], a["dialect"]),
    "flow": lambda a: flow.build(a["statement"], a["catalog"], a["diagnosis"]["score"]),
    "nodes": lambda a: lineage.build(a["statement"], a["diagnosis"]["findings"]),
    "plan": lambda a: repairs.build(a["statement"], a["diagnosis"]["findings"], a["diagnosis"]["score"], a["flow"], a["nodes"]),
    "metrics": lambda a: profile.metrics(a["statement"], a["catalog"]) if not a["statement"]["unsupported"] else [],
}


class Analysis(dict):
    """Parts of PARTS by name, each made when it is first read."""

    def __missing__(self, part: str):
        self[part] = made = PARTS[part](self)
        return made


def analyze(sql: str | None, notes: str | None = None) -> Analysis:
    return Analysis(sql=sql, notes=notes)


def extras(a: dict, notes: str | None = None) -> dict:
    """Presentation records and exports of an analysis."""
    s, c, d, g, f = (a[k] for k in ("statement", "catalog", "dialect", "diagnosis", "flow"))
    text, lines = formatting.format_sql(s["sql"])
    doc = exports.document(a, notes)
    return {
        "briefing": profile.briefing(s, c, d, g, f, a["plan"]), "review": profile.review(s, c, d, g, f, a["plan"], a["nodes"]), "chips": profile.chips(s, c, g, f), "sources": profile.sources(s, c),
        "formatted": text, "lineMap": lines, "rewrite": repairs.parameterize(s["sql"]), "notes": repairs.notes(s, g["findings"], f), "signals": lineage.signals(s, f, a["nodes"]), "rawLines": lineage.raw_lines(s["sql"]), "document": doc,
    }
