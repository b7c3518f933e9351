"""Extension: the relational constructs that the analyser models, run on sample tables and stated in SQL.

Name -> (DataFrame plan, SQL). The analyser itself runs nothing; these show what its rules are about (a filter in WHERE
or in ON of an outer join, NULL in NOT IN, a window's frame) and serve to compare two engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _money(c):
    """Sums of doubles depend on order; cents as integers don't."""
    return F.round(F.col(c) * 100).cast("long")


def _join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(_money("o_totalprice")).alias("cents"))


def _join_left(t):
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


def _join_right(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "right").groupBy("c_nationkey").agg(F.count("o_orderkey").alias("orders"), F.count("*").alias("n"))


def _join_full(t):
    a, b = t.supplier.select((F.col("s_suppkey") * 40).alias("k"), F.lit(1).alias("a")), t.customer.select(F.col("c_custkey").alias("k"), F.lit(1).alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def _join_using(t):
    return t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey").join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def _join_natural(t):
    return t.spark.sql("SELECT n_name, n_regionkey, r_name FROM {n} NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM {r})", n=t.nation, r=t.region)


def _join_cross(t):
    return t.region.crossJoin(t.nation).groupBy("r_name").agg(F.count("*").alias("n"))


def _join_theta(t):
    """Suppliers and nations of a lower key: a range condition, few rows on one side."""
    return t.supplier.join(F.broadcast(t.nation), F.col("n_nationkey") < F.col("s_nationkey")).groupBy("s_suppkey").agg(F.count("*").alias("n"))


def _join_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def _join_anti(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def _agg_having(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(_money("l_extendedprice")).alias("cents"), F.max("l_shipdate").alias("last")).where("n >= 30")


def _pricing(t):
    """Pricing summary by return flag and line status."""
    part = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return part.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.sum(_money("l_extendedprice")).alias("cents"), F.count("*").alias("n"))


def _rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def _aggregates(t):
    e = t.events
    return e.groupBy("event_type").agg(F.bool_or(F.col("value") > 90).alias("any_high"), F.bool_and(F.col("value") >= 0).alias("all_sound"), F.size(F.array_agg("event_id")).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), ",")).alias("users"))


def _distinct(t):
    return t.events.select("user_id", "event_type").distinct()


def _limit(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10).select("o_orderkey", "o_totalprice")


def _cte_chain(t):
    a = t.orders.groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).alias("cents"))
    b = t.customer.join(a, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("cents").alias("cents"))
    return t.nation.join(F.broadcast(b), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "cents")


_RECURSIVE = "WITH RECURSIVE r(n, total) AS (SELECT 1, CAST(0 AS BIGINT) UNION ALL SELECT n + 1, total + n FROM r WHERE n < 50) SELECT n, total FROM r"


def _subquery(t):
    mean = t.orders.agg(F.avg(_money("o_totalprice")).alias("mean"))
    return t.orders.crossJoin(F.broadcast(mean)).where(_money("o_totalprice") > F.col("mean")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _window_rank(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r")).where("r <= 3")


def _window_ranks(t):
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return t.customer.select("c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("q"))


def _window_frame(t):
    """LAST_VALUE by the default frame, and by the whole partition."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", F.last("o_orderkey").over(w).alias("by_default"), F.last("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("whole"), F.first("o_orderkey").over(w).alias("first"))


def _set(kind):
    def plan(t):
        a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.where("s_nationkey > 5").select(F.col("s_nationkey").alias("k"))
        return {"union_all": a.unionByName(b).groupBy("k").agg(F.count("*").alias("n")), "union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}[kind]

    return plan


def _not_in(t):
    """NOT IN over a list with NULL gives nothing; the guarded form gives the rest."""
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("k"))
    raw = c.where(~F.col("k").isin(1, 2) & F.lit(None).cast("boolean")).select(F.lit("raw").alias("form"), "c_custkey")
    return raw.unionByName(c.where(F.col("k").isNotNull() & ~F.col("k").isin(1, 2)).select(F.lit("guarded").alias("form"), "c_custkey"))


def _left_guard(t):
    """A filter on the nullable side in WHERE, and in ON."""
    o = t.orders.select("o_custkey", "o_totalprice")
    on = F.col("c_custkey") == F.col("o_custkey")
    w = t.customer.join(o, on, "left").where("o_totalprice > 200000").agg(F.count("*").alias("n")).select(F.lit("where").alias("place"), "n")
    return w.unionByName(t.customer.join(o.where("o_totalprice > 200000"), on, "left").agg(F.count("*").alias("n")).select(F.lit("on").alias("place"), "n"))


def _keyset(t):
    return t.orders.where("o_orderkey > 1000").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_custkey")


def _half_open(t):
    return t.events.where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp"))).groupBy("event_type").agg(F.count("*").alias("n"))


def _parameters(t):
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n FROM {o} WHERE o_custkey > :p1 AND o_orderpriority <> :p2 GROUP BY o_orderstatus", args={"p1": 100, "p2": "1-URGENT"}, o=t.orders)


_C = "SELECT c_nationkey AS k FROM customer"
_S = "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 5"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
PLANS: dict[str, tuple[Callable, str]] = {
    "rel_join_inner": (_join_inner, f"SELECT c_mktsegment, count(*) AS n, CAST(sum({_CENTS}) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "rel_join_left": (_join_left, "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "rel_join_right": (_join_right, "SELECT c_nationkey, count(o_orderkey) AS orders, count(*) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "rel_join_full": (_join_full, "SELECT coalesce(s_suppkey * 40, c_custkey) AS k, CAST(s_suppkey IS NOT NULL AS INT) AS a, CAST(c_custkey IS NOT NULL AS INT) AS b FROM supplier FULL JOIN customer ON s_suppkey * 40 = c_custkey"),
    "rel_join_using": (_join_using, "SELECT o_orderpriority, count(*) AS n FROM (SELECT l_orderkey AS o_orderkey FROM lineitem) JOIN orders USING (o_orderkey) GROUP BY 1"),
    "rel_join_natural": (_join_natural, "SELECT n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "rel_join_cross": (_join_cross, "SELECT r_name, count(*) AS n FROM region CROSS JOIN nation GROUP BY 1"),
    "rel_join_theta": (_join_theta, "SELECT s_suppkey, count(*) AS n FROM supplier JOIN nation ON n_nationkey < s_nationkey GROUP BY 1"),
    "rel_join_semi": (_join_semi, "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)"),
    "rel_join_anti": (_join_anti, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "rel_agg_having": (_agg_having, "SELECT l_partkey, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(l_shipdate) AS last FROM lineitem GROUP BY 1 HAVING count(*) >= 30"),
    "rel_pricing_summary": (_pricing, "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "rel_rollup": (_rollup, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, GROUPING_ID(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "rel_aggregates": (_aggregates, "SELECT event_type, bool_or(value > 90) AS any_high, bool_and(value >= 0) AS all_sound, count(*) AS n, md5(string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR))) AS users FROM events GROUP BY 1"),
    "rel_distinct": (_distinct, "SELECT DISTINCT user_id, event_type FROM events"),
    "rel_limit_offset": (_limit, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20"),
    "rel_cte_chain": (_cte_chain, f"WITH a AS (SELECT o_custkey, sum({_CENTS}) AS cents FROM orders GROUP BY 1), b AS (SELECT c_nationkey, sum(cents) AS cents FROM customer JOIN a ON c_custkey = o_custkey GROUP BY 1) SELECT n_name, CAST(cents AS BIGINT) AS cents FROM nation JOIN b ON n_nationkey = c_nationkey"),
    "rel_recursive_cte": (lambda t: t.spark.sql(_RECURSIVE), _RECURSIVE),
    "rel_subquery": (_subquery, f"SELECT o_orderstatus, count(*) AS n FROM orders WHERE {_CENTS} > (SELECT avg({_CENTS}) FROM orders) GROUP BY 1"),
    "rel_window_rank": (_window_rank, "SELECT o_custkey, o_orderkey, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3"),
    "rel_window_ranks": (_window_ranks, "SELECT c_custkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)"),
    "rel_window_frame": (_window_frame, "SELECT o_orderkey, last_value(o_orderkey) OVER w AS by_default, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
    "rel_union_all": (_set("union_all"), f"SELECT k, count(*) AS n FROM ({_C} UNION ALL {_S}) GROUP BY 1"),
    "rel_union": (_set("union"), f"{_C} UNION {_S}"),
    "rel_intersect": (_set("intersect"), f"{_C} INTERSECT {_S}"),
    "rel_except": (_set("except"), f"{_C} EXCEPT {_S}"),
    "rel_not_in_null": (_not_in, "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS k FROM customer) SELECT 'raw' AS form, c_custkey FROM c WHERE k NOT IN (1, 2, NULL) UNION ALL SELECT 'guarded', c_custkey FROM c WHERE k IS NOT NULL AND k NOT IN (1, 2)"),
    "rel_left_join_guard": (_left_guard, "SELECT 'where' AS place, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000 UNION ALL SELECT 'on', count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000"),
    "rel_keyset_page": (_keyset, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 25"),
    "rel_half_open_range": (_half_open, "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1"),
    "rel_named_parameters": (_parameters, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey > 100 AND o_orderpriority <> '1-URGENT' GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir))) for name, (plan, _) in PLANS.items()}
