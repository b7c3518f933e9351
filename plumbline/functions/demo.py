"""A large damaged statement with its schema notes: a chain of CTEs, generated from a rule."""

from __future__ import annotations

NOTES = """-- rows: fact_orders=95000000, dim_accounts=640000
-- sensitive: dim_accounts.owner_email
CREATE TABLE fact_orders (order_id bigint PRIMARY KEY, customer_id bigint NOT NULL, account_id bigint NOT NULL, event_date timestamp NOT NULL, amount numeric NOT NULL);
CREATE TABLE dim_accounts (account_id bigint PRIMARY KEY, segment text, region text, owner_email text);
CREATE INDEX ON fact_orders(account_id, event_date);
CREATE INDEX ON dim_accounts(region);"""


def statement(stages: int = 115) -> str:
    out = []
    for n in range(1, stages + 1):
        a, day, money, count, source = ("fo", "event_date", "SUM(fo.amount)", "COUNT(*)", "fact_orders fo") if n == 1 else ("s", "period", "SUM(s.revenue)", "SUM(s.order_count)", f"stage_{n - 1:03d} s")
        d = f"da_{n:03d}"
        fields = [f"{a}.customer_id", f"{a}.account_id", f"DATE_TRUNC('month', {a}.{day}) AS period", f"{money} AS revenue", f"{count} AS order_count"]
        out += [f"{'WITH' if n == 1 else ','} stage_{n:03d} AS (", "  SELECT", ",\n".join("    " + f for f in fields), f"  FROM {source}", f"  LEFT JOIN dim_accounts {d} ON {d}.account_id = {a}.account_id",
                f"  WHERE {a}.{day} >= DATE '2024-01-01'", f"    AND ({d}.segment = 'enterprise' OR {d}.region LIKE '%west%')", f"  GROUP BY {a}.customer_id, {a}.account_id, DATE_TRUNC('month', {a}.{day})", ")"]
    out += ["SELECT", "  customer_id,", "  account_id,", "  SUM(revenue) AS total_revenue,", "  SUM(order_count) AS modeled_orders,", f"FROM stage_{stages:03d} s", "JOIN WHERE s.account_id = da.account_id", "WHERE (s.revenue > 0", "GROUP BY customer_id, account_id", "ORDER BY total_revenue DESC", "OFFSET 500;"]
    return "\n".join(out)
