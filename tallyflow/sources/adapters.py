"""Ledger adapters: the driver's tables in the canonical ledger schema."""

from __future__ import annotations

from ..plans.relations import Spark, mart, relation

#: Which categories play which role; operators take them from here. SUBSCRIPTION is entertainment,
#: INVESTMENT finance; of the essentials, bills and health count with groceries.
ESSENTIALS = ("STANDARD", "SMALL")
TRANSFER, INVESTMENT, SUBSCRIPTION = "PROMO", "ECONOMY", "LARGE"


def names(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


#: Lines 1, 2 and 6 of an order cost a round price, so that operators on equal amounts find some.
AMOUNT = "CASE WHEN l_linenumber IN (1, 2, 6) THEN l_quantity * 100 ELSE l_extendedprice END"


@mart("month")
def ledger(d: Spark) -> str:
    """Lines as transactions of the supplier's nation; returned lines are credits."""
    return f"""
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
              CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS txn_id,
       s_nationkey AS user_id, l_shipdate AS ts, {d.month_name('l_shipdate')} AS month,
       CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS month_idx,
       CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(({AMOUNT}) AS DECIMAL(18,2)) END AS debit,
       CASE WHEN l_returnflag = 'R' THEN CAST(({AMOUNT}) AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS credit,
       concat('c-', CASE l_linenumber WHEN 7 THEN concat('u-', p_type) WHEN 6 THEN s_name ELSE p_brand END) AS cluster_id,
       CASE WHEN l_linenumber < 6 THEN p_brand END AS merchant,
       CASE WHEN l_linenumber = 6 THEN s_name END AS payee,
       CASE WHEN l_linenumber = 7 AND p_type = 'SMALL' THEN NULL WHEN l_linenumber = 5 AND p_type = 'MEDIUM' THEN 'Uncategorized' ELSE p_type END AS category,
       concat(p_name, CASE p_size % 10 WHEN 0 THEN ' LATE  FEE' WHEN 1 THEN ' refined finance charge' ELSE '' END) AS description,
       concat(CAST(s_nationkey AS STRING), '-', CAST(year(l_shipdate) AS STRING)) AS statement_id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""


@relation
def shopping(d: Spark) -> str:
    """Each customer's orders as their shopping."""
    return f"""
SELECT o_custkey AS user_id, CAST(o_orderkey AS STRING) AS txn_id, {d.month_name('o_orderdate')} AS month, CAST(o_totalprice AS DECIMAL(18,2)) AS debit
FROM orders WHERE o_totalprice > 0"""


@mart()
def ledger_balance(d: Spark) -> str:
    """The ledger with a running balance for each user: within a month, from what the months before it
    leave, so that no user's history is one group."""
    return """
SELECT l.*, o.opening + sum(l.credit - l.debit) OVER (PARTITION BY l.user_id, l.month ORDER BY l.ts, l.txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
FROM ledger l JOIN (
  SELECT user_id, month, coalesce(sum(net) OVER (PARTITION BY user_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opening
  FROM (SELECT user_id, month, sum(credit - debit) AS net FROM ledger GROUP BY user_id, month) AS m) AS o ON l.user_id = o.user_id AND l.month = o.month"""


@relation
def order_ledger(d: Spark) -> str:
    """Orders as transactions of the customer's nation."""
    return f"""
SELECT CAST(o_orderkey AS STRING) AS txn_id, c_nationkey AS user_id, o_orderdate AS ts, {d.month_name('o_orderdate')} AS month,
       CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month_idx,
       CASE WHEN o_orderstatus = 'O' THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS debit,
       CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS credit,
       concat('c-', CAST(o_custkey AS STRING)) AS cluster_id, c_name AS merchant, c_mktsegment AS category
FROM orders JOIN customer ON o_custkey = c_custkey"""


@relation
def clusters(d: Spark) -> str:
    """The counterparty dimension."""
    return """
SELECT user_id, cluster_id, max(merchant) AS merchant, max(payee) AS payee, max(category) AS category, count(*) AS cluster_length
FROM ledger GROUP BY user_id, cluster_id"""


@relation
def statements(d: Spark) -> str:
    """Statements with their periods; every third also has a copy that overlaps its end."""
    return f"""
SELECT user_id, statement_id, concat('bank', CAST(user_id % 3 AS STRING)) AS bank, CAST(min(ts) AS DATE) AS period_start, CAST(max(ts) AS DATE) AS period_end,
       count(*) AS total_rows FROM ledger GROUP BY user_id, statement_id
UNION ALL
SELECT user_id, concat(statement_id, '-again'), concat('bank', CAST(user_id % 3 AS STRING)), {d.add_days('CAST(max(ts) AS DATE)', '-40')}, {d.add_days('CAST(max(ts) AS DATE)', '10')}, count(*)
FROM ledger WHERE user_id % 3 = 0 GROUP BY user_id, statement_id"""
