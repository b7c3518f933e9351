"""What readers ask of the lineage of a statement, worked out within it: the views of nodes and edges (see views, native)
without their joins. Statements under one query_id are one graph, so they are brought together first; that is all that is
shuffled. Ids are the legacy ones."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.analysis import analyze
from plumbline.operators import shapes, views
from plumbline.operators.sections import arrow_of, reviewed

LEVELS = ("info", "low", "medium", "high")


class Graph:
    """Nodes, edges and findings of the statements of one query_id."""

    def __init__(self, analyses: list[dict]):
        self.nodes = [n for a in analyses for n in a["nodes"]]
        self.findings = [(i, f) for a in analyses for i, f in enumerate(a["diagnosis"]["findings"])]
        legacy = [{n["id"]: n["legacyId"] for n in a["nodes"]} for a in analyses]
        self.edges = list(dict.fromkeys((of[p], n["legacyId"]) for a, of in zip(analyses, legacy, strict=True) for n in a["nodes"] for p in n["predecessors"]))

    def risks(self) -> list[tuple]:
        """Edges and the worse severity of both ends."""
        worst: dict[str, int] = {}
        for n in self.nodes:
            worst[n["legacyId"]] = max(worst.get(n["legacyId"], 0), LEVELS.index(n["severity"]))
        return [(a, b, LEVELS[max(worst[a], worst[b])]) for a, b in self.edges]

    def around(self, seeds: Iterable[str], depth: int, limit: int) -> list[tuple]:
        """Nodes within depth edges of seeds, the limit nearest."""
        near: dict[str, set] = {}
        for a, b in self.edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        reached = dict.fromkeys(seeds, 0)
        edge = set(reached)
        for distance in range(1, depth + 1):
            edge = {y for x in edge for y in near.get(x, ())} - reached.keys()
            reached |= dict.fromkeys(edge, distance)
        return sorted(reached.items(), key=lambda x: (x[1], x[0]))[:limit]


def _key(text: str) -> str:
    return re.sub(r"\s+", " ", text, flags=re.A).strip(" ").lower()


def _neighbourhood(g: Graph) -> list[tuple]:
    return g.around({b for _, b in g.edges if b == "result-0"}, 3, 24)


def _related(g: Graph) -> list[tuple]:
    mine = {n["legacyId"] for n in g.nodes if n["kind"] == "projection"}
    return [(x,) for x in sorted(mine | {b for a, b in g.edges if a in mine} | {a for a, b in g.edges if b in mine})]


def _decision(g: Graph) -> list[tuple]:
    first: dict[str, tuple] = {}
    for n in g.nodes:
        if n["kind"] != "result":
            k, at = _key(n["text"]), (9999 if n["lineStart"] is None else n["lineStart"], n["legacyId"])
            first[k] = min(at, first.get(k, at))
    found: dict[int, tuple] = {}
    for i, f in g.findings:  # by position, the first node in order of lines
        k = _key(f["evidence"])
        if k and k in first and (i not in found or first[k] < found[i][0]):
            found[i] = (first[k], f["severity"])
    hot = [found[i][0][1] for i in sorted(found) if found[i][1] in ("high", "medium")][: views.SEEDS]
    return g.around([*hot, *[n["legacyId"] for n in g.nodes if n["kind"] == "result"]], *views.PERSPECTIVES["decision"])


def _layers(g: Graph) -> list[tuple]:
    if not g.nodes:
        return []
    kinds: dict[str, list[str]] = {}
    for n in g.nodes:
        kinds.setdefault(n["legacyId"], []).append(n["kind"])
    ends = [(risk, k, m) for a, b, risk in g.risks() for k in kinds[a] for m in kinds[b]]
    heavy = ("high", "medium")
    rows = [("risk", sum(n["severity"] in heavy or n["kind"] == "result" for n in g.nodes), sum(risk in heavy for risk, _, _ in ends))]
    for x, some in views.LAYERS.items():
        rows.append((x, sum(n["kind"] in some for n in g.nodes), sum(k in some or m in some for _, k, m in ends)))
    return [*rows, ("lineage", len(g.nodes), len(ends))]


def _resolved(g: Graph) -> list[tuple]:
    """Every legacy id, and one that no node has."""
    ids: dict[str, set] = {}
    for n in g.nodes:
        ids.setdefault(n["legacyId"], set()).add(n["id"])
    own = {n["id"] for n in g.nodes}
    out = []
    for target in [n["legacyId"] for n in g.nodes] + (["nowhere-0"] if g.nodes else []):
        status = "ambiguous" if len(ids.get(target, ())) > 1 else "resolved" if target in ids or target in own else "unsupported"
        out.append((target, status, status == "resolved"))
    return out


GRAPHS = {
    "edge_risks": ("from_id string, to_id string, risk string", Graph.risks),
    "lineage_neighbourhood": ("node string, distance int", _neighbourhood),
    "related_nodes": ("node string", _related),
    "decision_focus": ("node string, distance int", _decision),
    "layer_counts": ("layer string, nodes bigint, edges bigint", _layers),
    "resolved_ids": ("target string, status string, found boolean", _resolved),
}


def graph(statements: DataFrame, name: str) -> DataFrame:
    """query_id and the columns of a view of GRAPHS for statements(query_id, sql[, schema_text]); those without a query_id
    are left out, as joins by it would."""
    ddl, view = GRAPHS[name]
    part = reviewed(statements).where(F.col("query_id").isNotNull())
    spark = statements.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    text = f"query_id {part.schema['query_id'].dataType.simpleString()}, {ddl}"
    arrow = arrow_of(text)
    rows_of = lambda texts: view(Graph([analyze(*x) for x in texts]))
    return part.repartition(parts, "query_id").sortWithinPartitions("query_id").mapInArrow(lambda batches: shapes.grouped(batches, rows_of, arrow), text)
