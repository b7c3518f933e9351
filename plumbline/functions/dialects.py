"""Dialect signals: patterns of twelve dialects, their score, and the choice between them."""

from __future__ import annotations

import re

#: Dialect id, label, and (pattern, signal) pairs. Patterns ignore case but for the one marked (?-i:...).
DIALECTS: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("postgres", "PostgreSQL", [
        (r"::\s*[a-z_][\w$]*", "double-colon casts"),
        (r"\bdistinct\s+on\s*\(", "DISTINCT ON"),
        (r"\bilike\b", "ILIKE"),
        (r"->>|#>>|jsonb?", "JSON operators"),
        (r"\bserial\b|\bbigserial\b", "serial types"),
    ]),
    ("bigquery", "BigQuery", [
        (r"`[^`]+\.[^`]+\.[^`]+`", "project.dataset.table identifiers"),
        (r"\bunnest\s*\(", "UNNEST"),
        (r"\bqualify\b", "QUALIFY"),
        (r"\bsafe_(cast|offset|ordinal)\s*\(", "SAFE functions"),
        (r"\bselect\s+\*\s+except\s*\(", "SELECT * EXCEPT"),
        (r"_partition(time|date)|_table_suffix", "partition or wildcard pseudo columns"),
    ]),
    ("snowflake", "Snowflake", [
        (r"\bqualify\b", "QUALIFY"),
        (r"\blateral\s+flatten\b|\bflatten\s*\(", "FLATTEN"),
        (r"\bvariant\b", "VARIANT"),
        (r"\biff\s*\(", "IFF"),
        (r"\bzeroifnull\s*\(", "ZEROIFNULL"),
        (r"\bsample\s*\(", "SAMPLE"),
    ]),
    ("databricks", "Databricks / Spark SQL", [
        (r"\blateral\s+view\s+(outer\s+)?explode\b|\bposexplode\s*\(", "LATERAL VIEW EXPLODE"),
        (r"\busing\s+delta\b|\bdelta\.`", "Delta tables"),
        (r"\b(cluster|distribute|sort)\s+by\b", "Spark distribution clauses"),
        (r"\bfrom_json\s*\(|\bschema_of_json\s*\(", "Spark JSON functions"),
        (r"\bcollect_(list|set)\s*\(", "collection aggregates"),
    ]),
    ("trino", "Trino / Presto", [
        (r"\bcross\s+join\s+unnest\b", "CROSS JOIN UNNEST"),
        (r"\bwith\s+ordinality\b", "WITH ORDINALITY"),
        (r"\bapprox_(distinct|percentile|set)\s*\(", "approximate aggregates"),
        (r"\bdate_parse\s*\(|\bfrom_iso8601_", "Trino date functions"),
        (r"\btry_cast\s*\(", "TRY_CAST"),
    ]),
    ("duckdb", "DuckDB", [
        (r"\bread_(parquet|csv|csv_auto|json|json_auto)\s*\(", "file table functions"),
        (r"\bselect\s+\*\s+(exclude|replace)\b", "SELECT * EXCLUDE/REPLACE"),
        (r"\bgroup\s+by\s+all\b", "GROUP BY ALL"),
        (r"\bstruct_pack\s*\(|\blist_transform\s*\(", "DuckDB nested functions"),
        (r"\bpivot\b[\s\S]*\bon\b", "DuckDB PIVOT"),
    ]),
    ("redshift", "Amazon Redshift", [
        (r"\b(distkey|sortkey|diststyle)\b", "distribution or sort keys"),
        (r"\bapproximate\s+count\s*\(\s*distinct", "APPROXIMATE COUNT DISTINCT"),
        (r"\bconvert_timezone\s*\(", "CONVERT_TIMEZONE"),
        (r"\bdate_cmp_\w+\s*\(", "Redshift date comparison functions"),
        (r"\bqualify\b", "QUALIFY"),
    ]),
    ("clickhouse", "ClickHouse", [
        (r"\barray\s+join\b", "ARRAY JOIN"),
        (r"\bprewhere\b", "PREWHERE"),
        (r"\bglobal\s+(any\s+|all\s+)?join\b", "GLOBAL JOIN"),
        (r"\barg(max|min)\s*\(", "argMax/argMin"),
        (r"(?-i:\btoDateTime\w*\s*\()", "ClickHouse date functions"),
        (r"\bfrom\s+[\w.`]+\s+final\b", "FINAL"),
    ]),
    ("sqlserver", "SQL Server", [
        (r"\btop\s*\(?\s*\d+", "TOP"),
        (r"\bwith\s*\(\s*nolock\s*\)", "NOLOCK"),
        (r"\bdate(add|diff|part)\s*\(", "DATEADD family"),
        (r"\bisnull\s*\(", "ISNULL"),
        (r"\[[^\]]+\]", "bracket identifiers"),
        (r"(^|[^@])@\w+|#\w+", "T-SQL variables or temp tables"),
    ]),
    ("mysql", "MySQL", [
        (r"`[^`]+`", "backtick identifiers"),
        (r"\blimit\s+\d+\s*,\s*\d+", "LIMIT offset,count"),
        (r"\bsql_calc_found_rows\b", "SQL_CALC_FOUND_ROWS"),
        (r"\b(force|use|ignore)\s+index\b", "index hints"),
        (r"\bifnull\s*\(", "IFNULL"),
        (r"\bdate_format\s*\(", "DATE_FORMAT"),
    ]),
    ("oracle", "Oracle", [
        (r"\(\+\)", "legacy outer join"),
        (r"\brownum\b", "ROWNUM"),
        (r"\bnvl\s*\(", "NVL"),
        (r"\bconnect\s+by\b", "CONNECT BY"),
        (r"\bminus\b", "MINUS"),
        (r"\bfrom\s+dual\b", "DUAL"),
    ]),
    ("sqlite", "SQLite", [
        (r"\bpragma\b", "PRAGMA"),
        (r"\browid\b", "ROWID"),
        (r"\bstrftime\s*\(", "strftime"),
        (r"\bdatetime\s*\(", "datetime"),
        (r"\bglob\b", "GLOB"),
    ]),
]
_COMPILED = [(i, label, [(re.compile(p, re.I | re.A), s) for p, s in pairs]) for i, label, pairs in DIALECTS]


def label_of(dialect: str) -> str:
    return next((label for i, label, _ in DIALECTS if i == dialect), "ANSI-ish" if dialect == "ansi" else dialect or "Unknown")


def detect(sql: str | None) -> dict:
    scores = []
    for i, label, pairs in _COMPILED:
        found = [s for p, s in pairs if p.search(sql or "")]
        if found:
            scores.append({"id": i, "label": label, "score": len(found), "signals": found})
    scores.sort(key=lambda x: (-x["score"], x["label"].lower()))
    if not scores:
        return {"primary": "ansi", "label": "ANSI-ish", "confidence": "low", "signals": [], "alternatives": [], "scores": []}
    top, others = scores[0], scores[1:]
    lead = top["score"] - (others[0]["score"] if others else -2)
    confidence = "high" if top["score"] >= 3 and lead >= 2 else "medium" if top["score"] >= 2 else "low"
    return {"primary": top["id"], "label": top["label"], "confidence": confidence, "signals": top["signals"], "alternatives": others[:3], "scores": scores}
