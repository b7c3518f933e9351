"""Selections and layouts over the lineage of a statement: what a reader looks at, without drawing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import ORDER
from plumbline.operators.native import neighbourhood

#: Perspective: depth and nodes at most.
PERSPECTIVES = {"decision": (10, 22), "metrics": (8, 32)}
SEEDS = 5


def layout(nodes: DataFrame) -> DataFrame:
    """query_id, node_id, layer, place, of: columns by clause, rows by id within a column; y is (place + 0.5) / of."""
    kinds = [*ORDER, "result"]
    layer = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int") - 1
    column = Window.partitionBy("query_id", "layer")
    placed = nodes.select("query_id", "node_id", "kind", layer.alias("layer"))
    place = (F.row_number().over(column.orderBy("node_id")) - 1).alias("place")
    return placed.select("query_id", "node_id", "kind", "layer", place, F.count("*").over(column).alias("of"))


def edge_risks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, from_id, to_id and the worse severity of both ends."""
    rank = F.array_position(F.array(*map(F.lit, ("info", "low", "medium", "high"))), F.col("severity"))
    n = nodes.select("query_id", F.col("node_id").alias("id"), rank.alias("rank"))
    ends = edges.select("query_id", "from_id", "to_id", F.explode(F.array("from_id", "to_id")).alias("id")).join(n, ["query_id", "id"])
    worst = ends.groupBy("query_id", "from_id", "to_id").agg(F.max("rank").alias("rank"))
    return worst.withColumn("risk", F.element_at(F.array(*map(F.lit, ("info", "low", "medium", "high"))), F.col("rank").cast("int"))).drop("rank")


def related(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, node: each target(query_id, node) and its direct neighbours."""
    both = edges.select("query_id", F.col("from_id").alias("node"), F.col("to_id").alias("near")).unionByName(edges.select("query_id", F.col("to_id").alias("node"), F.col("from_id").alias("near")))
    return targets.select("query_id", "node").unionByName(both.join(targets, ["query_id", "node"], "left_semi").select("query_id", F.col("near").alias("node"))).distinct()


def evidence_key(text):
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def finding_targets(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, code, pos, node: the first node, by line, whose text is a finding's evidence."""
    n = nodes.where("kind <> 'result'").select("query_id", F.col("node_id").alias("node"), "line_start", evidence_key(F.col("text")).alias("k"))
    f = findings.select("query_id", "pos", "code", "severity", evidence_key(F.col("evidence")).alias("k")).where("k <> ''")
    first = F.row_number().over(Window.partitionBy("query_id", "pos").orderBy(F.coalesce("line_start", F.lit(9999)), "node"))
    return f.join(n, ["query_id", "k"]).withColumn("first", first).where("first = 1").select("query_id", "pos", "code", "severity", "node")


def focus(perspective: str, nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """query_id, node, distance in a perspective: around the worst findings, around the projections, or everything."""
    if perspective == "debug":
        return nodes.select("query_id", F.col("node_id").alias("node"), F.lit(0).alias("distance"))
    depth, limit = PERSPECTIVES[perspective]
    if perspective == "metrics":
        seeds = nodes.where("kind IN ('projection', 'result')").select("query_id", F.col("node_id").alias("node"))
    else:
        order = Window.partitionBy("query_id").orderBy("pos")
        hot = finding_targets(findings, nodes).where("severity IN ('high', 'medium')").withColumn("n", F.row_number().over(order)).where(F.col("n") <= SEEDS)
        seeds = hot.select("query_id", "node").unionByName(nodes.where("kind = 'result'").select("query_id", F.col("node_id").alias("node")))
    return neighbourhood(edges, seeds, depth, limit)


def navigator(findings: DataFrame, metrics: DataFrame, sources: DataFrame, actions: DataFrame) -> DataFrame:
    """query_id, list, place, label: the first 4 risks, 5 metrics, 5 sources and 4 actions of each statement."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    lists = (
        (findings, "risks", 4, "title", [rank, F.col("pos")]),
        (metrics, "metrics", 5, "label", [F.col("legacy_id"), F.col("label")]),
        (sources, "sources", 5, "name", [F.col("source_id")]),
        (actions, "actions", 4, "title", [F.col("rank")]),
    )
    out = None
    for df, name, most, label, order in lists:
        part = df.select("query_id", F.lit(name).alias("list"), F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("place"), F.col(label).alias("label")).where(F.col("place") <= most)
        out = part if out is None else out.unionByName(part)
    return out


# layers and filters -------------------------------------------------------------------------------------------------

#: Kinds of nodes in a layer and under a filter, and the weight of a node by perspective.
LAYERS = {"grain": ("group", "having", "projection", "result"), "metrics": ("source", "join", "projection", "result")}
FILTERS = {"sources": ("source", "cte"), "joins": ("join",), "filters": ("where", "having"), "grain": ("group", "order", "limit"), "select": ("projection",)}
MEASURED = ("source", "cte", "group", "having", "projection", "result")


def in_layer(layer: str, kind=None, severity=None):
    """Whether a node belongs to a layer: risk, grain, metrics, or one that has all (lineage, motion)."""
    kind, severity = F.col("kind") if kind is None else kind, F.col("severity") if severity is None else severity
    if layer == "risk":
        return severity.isin("high", "medium") | (kind == "result")
    return kind.isin(*LAYERS[layer]) if layer in LAYERS else F.lit(True)


def shown(hidden: tuple[str, ...] = ()):
    """Whether a node is visible when the filters in hidden are off; results always are."""
    off = [k for name in hidden for k in FILTERS[name]]
    return ~F.col("kind").isin(*off) if off else F.lit(True)


def weight(perspective: str):
    """How much of a node a perspective shows, from 0 to 1."""
    kind, severity = F.col("kind"), F.col("severity")
    if perspective == "decision":
        return F.when((kind == "result") | (severity == "high"), 1.0).when((severity == "medium") | kind.isin("join", "group", "having"), 0.7).otherwise(0.28)
    if perspective == "metrics":
        return F.when(kind.isin(*MEASURED), 1.0).when(kind.isin("join", "where"), 0.68).otherwise(0.4)
    return F.lit(1.0)


def layer_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, layer, nodes, edges in it: an edge is in the risk layer by its own risk, elsewhere by either end."""
    names = ("risk", "grain", "metrics", "lineage")
    n = nodes.groupBy("query_id").agg(*[F.count_if(in_layer(x)).alias(x) for x in names])
    risks = edge_risks(edges, nodes)
    kinds = nodes.select("query_id", "node_id", "kind")
    ends = risks.join(kinds.withColumnsRenamed({"node_id": "from_id", "kind": "a"}), ["query_id", "from_id"]).join(kinds.withColumnsRenamed({"node_id": "to_id", "kind": "b"}), ["query_id", "to_id"])
    belongs = {"risk": F.col("risk").isin("high", "medium"), "lineage": F.lit(True)} | {x: F.col("a").isin(*LAYERS[x]) | F.col("b").isin(*LAYERS[x]) for x in LAYERS}
    e = ends.groupBy("query_id").agg(*[F.count_if(belongs[x]).alias(f"e_{x}") for x in names])
    both = n.join(e, "query_id", "left")
    rows = F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).alias("nodes"), F.coalesce(F.col(f"e_{x}"), F.lit(0).cast("long")).alias("edges")) for x in names])
    return both.select("query_id", F.explode(rows).alias("r")).select("query_id", "r.*")


def visible_counts(nodes: DataFrame) -> DataFrame:
    """query_id, hidden, visible: nodes left with each filter off, and their weight for decisions."""
    rows = F.array(*[F.struct(F.lit(x).alias("hidden"), shown((x,)).alias("yes")) for x in FILTERS])
    each = nodes.select("query_id", weight("decision").alias("w"), F.explode(rows).alias("r"))
    return each.groupBy("query_id", F.col("r.hidden").alias("hidden")).agg(F.count_if(F.col("r.yes")).alias("visible"), F.round(F.sum(F.when(F.col("r.yes"), F.col("w")).otherwise(0.0)), 2).alias("weight"))


def line_nodes(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, number, start, end, node_id of raw lines and the first node, by clause and line, that spans each; none if no node does."""
    layer = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    n = nodes.where("kind <> 'result' AND line_start IS NOT NULL").select("query_id", "node_id", "line_start", F.coalesce("line_end", "line_start").alias("line_end"), layer.alias("layer"))
    met = lines.join(n, (lines["query_id"] == n["query_id"]) & lines["number"].between(n["line_start"], n["line_end"]), "left").drop(n["query_id"])
    return met.groupBy("query_id", "number", "start", "end").agg(F.min_by("node_id", F.struct("layer", "line_start", "node_id")).alias("node_id"))


def resolved(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, target, status, node_id: targets by a node's legacy id, else by its own; ambiguous where a legacy id means several."""
    by_legacy = nodes.groupBy("query_id", F.col("legacy_id").alias("target")).agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("old"))
    own = nodes.select("query_id", F.col("node_id").alias("target"), F.col("node_id").alias("new")).distinct()
    found = targets.select("query_id", "target").join(by_legacy, ["query_id", "target"], "left").join(own, ["query_id", "target"], "left")
    status = F.when(F.col("n") > 1, "ambiguous").when(F.coalesce("old", "new").isNotNull(), "resolved").otherwise("unsupported")
    return found.select("query_id", "target", status.alias("status"), F.when(status == "resolved", F.coalesce("old", "new")).otherwise("").alias("node_id"))


def same_ids(a, b):
    """Whether two arrays hold the same ids, in any order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
