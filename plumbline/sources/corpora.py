"""Statement corpora: files, tables, and generated statements that two engines build alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "-- rows: orders=15000, customer=1500\nCREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey bigint, o_orderdate timestamp);\nCREATE TABLE customer (c_custkey bigint PRIMARY KEY, c_name text, email text);"

#: Statement templates by o_orderkey % 8; the text is SQL that Spark and DuckDB both read.
ORDERS = """
SELECT o_orderkey AS query_id, CAST(o_orderkey % 8 AS INT) AS template, CASE o_orderkey % 8
  WHEN 0 THEN concat('SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = ', CAST(o_custkey AS STRING))
  WHEN 1 THEN concat('SELECT * FROM orders o LIMIT ', CAST(o_custkey % 50 + 1 AS STRING))
  WHEN 2 THEN concat('SELECT c.c_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > ', CAST(o_custkey AS STRING))
  WHEN 3 THEN 'SELECT o.o_custkey, COUNT(*) AS n FROM orders o GROUP BY o.o_custkey HAVING COUNT(*) > 3 ORDER BY n'
  WHEN 4 THEN concat('SELECT o.o_orderkey FROM orders o WHERE o.o_custkey NOT IN (', CAST(o_custkey AS STRING), ', NULL)')
  WHEN 5 THEN 'WITH w AS (SELECT o.o_custkey, o.o_orderkey FROM orders o) SELECT w.o_custkey FROM w WHERE w.o_orderkey IS NOT NULL'
  WHEN 6 THEN concat('SELECT c.email FROM customer c WHERE lower(c.c_name) = ''x', CAST(o_custkey AS STRING), '''')
  ELSE 'SELECT o.o_orderkey FROM orders o UNION SELECT c.c_custkey FROM customer c' END AS sql
FROM orders"""
#: The findings of each template, by hand: template, code, severity, title.
EXPECTED = """
  (0, 'W6', 'info', 'Predicate contains inline literal values'), (0, 'W7', 'low', 'Filtered column lacks an index note'),
  (1, 'P1', 'medium', 'Wildcard projection broadens the blast radius'), (1, 'O1', 'low', 'LIMIT without ORDER BY is nondeterministic'),
  (2, 'J4', 'medium', 'Join column is not indexed in schema notes'), (2, 'J5', 'high', 'WHERE clause can erase LEFT JOIN preservation'), (2, 'W6', 'info', 'Predicate contains inline literal values'),
  (3, 'W6', 'info', 'Predicate contains inline literal values'), (3, 'O3', 'low', 'ORDER BY has no result bound'),
  (4, 'W1', 'high', 'NOT IN can fail in the presence of NULL'), (4, 'W6', 'info', 'Predicate contains inline literal values'), (4, 'W7', 'low', 'Filtered column lacks an index note'),
  (5, 'D02', 'info', 'No major static hazards detected'),
  (6, 'P2', 'high', 'Sensitive field reaches the result set'), (6, 'W5', 'medium', 'Function-wrapped column is likely non-sargable'), (6, 'W6', 'info', 'Predicate contains inline literal values'), (6, 'W7', 'low', 'Filtered column lacks an index note'),
  (7, 'D5', 'low', 'UNION performs duplicate elimination')"""
#: One statement in a dialect for each nation.
NATIONS = """
SELECT n_nationkey AS query_id, CASE n_nationkey % 13
  WHEN 0 THEN 'SELECT x::int, y->>''k'' FROM t WHERE a ILIKE ''b'''
  WHEN 1 THEN 'SELECT * EXCEPT (a) FROM `p.d.t` WHERE _PARTITIONTIME > 1 QUALIFY 1 = 1'
  WHEN 2 THEN 'SELECT IFF(a, 1, 2), ZEROIFNULL(b) FROM t, LATERAL FLATTEN(input => c)'
  WHEN 3 THEN 'SELECT collect_list(a) FROM t LATERAL VIEW explode(b) x AS y DISTRIBUTE BY a'
  WHEN 4 THEN 'SELECT approx_distinct(a), TRY_CAST(b AS int) FROM t CROSS JOIN UNNEST(c) WITH ORDINALITY'
  WHEN 5 THEN 'SELECT a, count(*) FROM read_parquet(''f'') GROUP BY ALL'
  WHEN 6 THEN 'SELECT APPROXIMATE COUNT(DISTINCT a), CONVERT_TIMEZONE(b) FROM t'
  WHEN 7 THEN 'SELECT argMax(a, b), toDateTime(c) FROM t FINAL PREWHERE d = 1'
  WHEN 8 THEN 'SELECT TOP 5 [a], ISNULL(b, 0) FROM t WITH (NOLOCK)'
  WHEN 9 THEN 'SELECT SQL_CALC_FOUND_ROWS IFNULL(`a`, 0) FROM t LIMIT 5, 10'
  WHEN 10 THEN 'SELECT NVL(a, 0) FROM t WHERE b = c(+) AND ROWNUM < 5 MINUS SELECT 1 FROM DUAL'
  WHEN 11 THEN 'SELECT rowid, strftime(a), datetime(b) FROM t WHERE c LIKE ''x'''
  ELSE 'SELECT a FROM t' END AS sql
FROM nation"""


def generated(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """query_id, sql, schema_text of the orders or nation statements."""
    table, text = {"orders": ("orders", ORDERS), "nations": ("nation", NATIONS)}[which]
    rows = spark.sql(text.replace(f"FROM {table}", "FROM {rows}") if which == "nations" else text[: text.rindex("FROM orders")] + "FROM {rows}", rows=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    # reviewing costs far more than moving a statement: spread them where the table has fewer parts than there are cores
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows.withColumn("schema_text", F.lit(NOTES if which == "orders" else ""))


def from_files(spark: SparkSession, folder: str) -> DataFrame:
    """query_id (path), sql of every file of a folder."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("query_id"), F.col("value").alias("sql"))


def notes_of(tables: dict[str, DataFrame]) -> str:
    """Schema notes of DataFrames: DDL from their schemas, and counted rows."""
    ddl = [f"CREATE TABLE {name} (" + ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields) + ");" for name, df in tables.items()]
    counts = ", ".join(f"{name}={df.count()}" for name, df in tables.items())
    return "\n".join([f"-- rows: {counts}", *ddl])


def write_exports(exports: DataFrame, folder: str, kind: str = "json") -> None:
    """One text file part for each task; every row is a whole document. kind: json or markdown."""
    if kind not in ("json", "markdown"):
        raise ValueError("json or markdown")
    exports.select(kind).write.mode("errorifexists").option("lineSep", "\n").text(f"{folder}/{kind}")


def write_files(files: DataFrame, folder: str) -> None:
    """A folder filename=... for each artifact of export_files(format, ok, filename, content), holding its one text file;
    equal statements have one artifact."""
    one = files.where("ok").dropDuplicates(["filename"]).select("filename", "content")
    one.write.mode("errorifexists").partitionBy("filename").option("lineSep", "\n").text(folder)
