"""Operators made of Spark's own expressions: dialect choice, rule filters, text safety, digests, graph walks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.dialects import DIALECTS
from plumbline.functions.rules import PREDICATE_RULES, WEIGHTS
from plumbline.sources.shared import cut

# dialects -------------------------------------------------------------------------------------------------------------


def _java(pattern: str) -> str:
    return "(?i)" + pattern


def dialect_scores(statements: DataFrame) -> DataFrame:
    """query_id, dialect, label, score, signals of every dialect with at least one signal. A projection, then an explode
    of at most twelve entries: nothing is shuffled and no pattern table is joined."""
    entries = []
    for dialect, label, pairs in DIALECTS:
        hits = F.filter(F.array(*[F.when(F.col("sql").rlike(_java(p)), F.lit(s)) for p, s in pairs]), lambda x: x.isNotNull())
        entries.append(F.struct(F.lit(dialect).alias("dialect"), F.lit(label).alias("label"), F.size(hits).alias("score"), hits.alias("signals")))
    found = F.filter(F.array(*entries), lambda e: e["score"] > 0)
    return statements.select("query_id", F.explode(found).alias("e")).select("query_id", "e.*")


def dialects(statements: DataFrame) -> DataFrame:
    """query_id, dialect, confidence and alternatives of each statement, within the row."""
    scored = []
    for dialect, label, pairs in DIALECTS:
        score = sum((F.col("sql").rlike(_java(p)).cast("int") for p, _ in pairs), F.lit(0))
        scored.append(F.struct((-score).alias("rank"), F.lower(F.lit(label)).alias("by"), F.lit(dialect).alias("dialect")))
    ranked = F.filter(F.array_sort(F.array(*scored)), lambda e: e["rank"] < 0)
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    top, lead = -first["rank"], F.coalesce(second["rank"], F.lit(99)) - first["rank"]
    confidence = F.when((top >= 3) & (second.isNull() | (lead >= 2)), "high").when(top >= 2, "medium").otherwise("low")
    return statements.select("query_id", ranked.alias("r")).select(
        "query_id", F.coalesce(first["dialect"], F.lit("ansi")).alias("dialect"), confidence.alias("confidence"), F.array_join(F.transform(F.slice("r", 2, 3), lambda e: e["dialect"]), ",").alias("alternatives")
    )


# rules and scores -----------------------------------------------------------------------------------------------------


def predicate_hits(expressions: DataFrame) -> DataFrame:
    """query_id, pos, code, severity, title of pattern rules over expressions(query_id, clause, pos, text)."""
    rules = [F.when(F.col("text").rlike(_java(p)), F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(t).alias("title"))) for c, s, _, t, p, _ in PREDICATE_RULES]
    part = expressions.where(F.col("clause").isin("where", "having"))
    return part.select("query_id", "clause", "pos", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r")).select("query_id", "clause", "pos", "r.*")


def score(findings: DataFrame) -> DataFrame:
    """query_id, score, risk_level of findings(query_id, severity)."""
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), F.col("severity"))
    total = findings.groupBy("query_id").agg(F.least(F.lit(100), F.sum(weight)).cast("int").alias("score"))
    return total.withColumn("risk_level", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 28, "medium").when(F.col("score") >= 8, "low").otherwise("info"))


# text safety ----------------------------------------------------------------------------------------------------------

_BIDI = [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0), 0x061C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)]


def visible(text: Column) -> Column:
    """Control and direction characters as \\uXXXX; tabs and line breaks stay."""
    mark = "[" + "".join(f"\\x{{{c:x}}}" for c in _BIDI) + "]"
    spelled = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(mark), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))).otherwise(c))
    return F.when(text.rlike(mark), F.array_join(spelled, "")).otherwise(text)


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\n+", " "), r"([!-/:-@\[-`{-~])", r"\\$1")


def class_token(text: Column, fallback: str = "unknown") -> Column:
    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9_-]*\z"), text).otherwise(F.lit(fallback))


def css_string(text: Column) -> Column:
    safe = lambda c: F.when(c.rlike("^[A-Za-z0-9_-]$"), c).otherwise(F.concat(F.lit("\\"), F.hex(F.ascii(c)), F.lit(" ")))
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), safe), "")


def strip_comments(sql: Column) -> Column:
    """Comments as one space each; strings and quoted names are stepped over."""
    return F.regexp_replace(sql, r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)", "$1 ")


def safe_filename(name: Column, extension: str) -> Column:
    return name.rlike(rf"^[A-Za-z0-9][A-Za-z0-9._-]*\.{re.escape(extension)}\z") & (F.length(name) <= 128)


def text_token_counts(text: Column) -> dict[str, Column]:
    """Words, numbers, strings and open parentheses of a text, by patterns alone."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return {"words": count(r"[A-Za-z_][A-Za-z0-9_]*"), "numbers": count(r"\b[0-9][0-9._]*"), "opens": count(r"\("), "closes": count(r"\)")}


def fnv64(text: Column) -> Column:
    """FNV-1a of a text's code points as 16 hex digits, in two 32-bit halves: no overflow in any step."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))

    def step(h: Column, c: Column) -> Column:
        x = h["lo"].bitwiseXOR(F.ascii(c).cast("long"))
        carry = F.shiftright(x * 435, 32)
        return F.struct(low(h["hi"] * 435 + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8) + carry).alias("hi"), low(x * 435).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    half = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda h: F.concat(half(h["hi"]), half(h["lo"])))


def occurrences(records: DataFrame) -> DataFrame:
    """stable_id for records(query_id, base, pos): the base, then -r02, -r03 ... in order of pos."""
    n = F.row_number().over(Window.partitionBy("query_id", "base").orderBy("pos"))
    return records.withColumn("n", n).withColumn("stable_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat(F.col("base"), F.format_string("-r%02d", "n")))).drop("n")


# relations over sections ----------------------------------------------------------------------------------------------


def raw_lines(statements: DataFrame) -> DataFrame:
    """query_id, number, text, start, end of every line; CRLF counts as one."""
    lines = F.split("sql", r"\r?\n")
    at = statements.select("query_id", F.posexplode(lines).alias("i", "text"))
    # a running sum over a statement's lines: one pass, where a sum from the start for each line would be quadratic
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("query_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("int")
    return at.select("query_id", (F.col("i") + 1).alias("number"), "text", start.alias("start"), (start + F.length("text")).alias("end"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """query_id, node, distance of the nodes within depth edges of seeds(query_id, node), the limit nearest of each
    statement; edges(query_id, from_id, to_id) count both ways. One join a step, on (query_id, node), between written
    tables: a step's new nodes border on the step before, so they are new if that step and the one before it lack them,
    and no step reads or writes more than its own nodes. It ends when a step reaches nothing new."""
    both = edges.select("query_id", F.col("from_id").alias("node"), F.col("to_id").alias("next")).unionByName(edges.select("query_id", F.col("to_id").alias("node"), F.col("from_id").alias("next")))
    both = cut(both.distinct(), "neighbours")
    levels = [cut(seeds.select("query_id", "node").distinct(), "reached")]
    for _ in range(depth):
        fresh = levels[-1].join(both, ["query_id", "node"]).select("query_id", F.col("next").alias("node")).distinct()
        for known in levels[-2:]:
            fresh = fresh.join(known, ["query_id", "node"], "left_anti")
        fresh = cut(fresh, "reached")
        if fresh.isEmpty():
            break
        levels.append(fresh)
    reached = reduce(DataFrame.unionByName, [x.withColumn("distance", F.lit(i)) for i, x in enumerate(levels)])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "node"))
    return reached.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def lens(formatted: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, line, node_id: formatted lines beside the lineage nodes whose raw lines they cover, narrowest first."""
    n = nodes.where("line_start IS NOT NULL").select("query_id", "node_id", "kind", "severity", "line_start", "line_end")
    met = formatted.join(n, "query_id").where("raw_start <= line_end AND raw_end >= line_start")
    first = F.row_number().over(Window.partitionBy("query_id", "line").orderBy(F.col("line_end") - F.col("line_start"), "node_id"))
    return met.withColumn("rank", first).select("query_id", "line", "text", "node_id", "kind", "severity", "rank")


def stage_routes(nodes: DataFrame, size: int = 8, most: int = 8) -> DataFrame:
    """CTE nodes in order, in groups of size, the first groups only (a report)."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("line_start", F.lit(9999)), "node_id"))
    part = nodes.where("kind = 'cte'").withColumn("route", F.floor((order - 1) / size).cast("int")).where(F.col("route") < most)
    return part.groupBy("query_id", "route").agg(F.count("*").alias("nodes"), F.min("line_start").alias("from_line"), F.max("line_end").alias("to_line"))


def history(snapshots: DataFrame, most: int = 80) -> DataFrame:
    """The latest snapshots of each key, without those equal to the one before."""
    order = Window.partitionBy("key").orderBy("ts", "snapshot")
    fresh = snapshots.withColumn("was", F.lag("snapshot").over(order)).where(~F.col("snapshot").eqNullSafe(F.col("was")))
    back = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("snapshot")))
    return fresh.drop("was").withColumn("back", back).where(F.col("back") <= most)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node: a check, empty for sound graphs."""
    ids = nodes.select("query_id", F.col("node_id").alias("id"))
    ends = edges.select("query_id", F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.join(ids, ["query_id", "id"], "left_anti").distinct()
