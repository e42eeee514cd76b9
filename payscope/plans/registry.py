"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle (when SQL can
express it) is an ANSI SQL string over the driver's base tables.  The
derived views are inlined as CTEs so the SQL runs on the raw tables.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# -- DuckDB text of the derived views (same definitions as sources/views.py) --

TXN_CTE = """e AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
t AS (SELECT *, CASE WHEN event_type = 'error' OR k >= 95 THEN 1 ELSE 0 END AS bad FROM e),
transactions AS (
SELECT event_id AS transaction_id,
       ts AS txn_ts,
       concat('MERCH', CASE WHEN user_id + 1 < 10000 THEN lpad(CAST(user_id + 1 AS VARCHAR), 5, '0') ELSE CAST(user_id + 1 AS VARCHAR) END) AS merchant_id,
       concat('CUST', CASE WHEN (event_id // 1000) * 10 + event_id % 10 + 1 < 100000
              THEN lpad(CAST((event_id // 1000) * 10 + event_id % 10 + 1 AS VARCHAR), 6, '0')
              ELSE CAST((event_id // 1000) * 10 + event_id % 10 + 1 AS VARCHAR) END) AS customer_id,
       CASE event_id % 3 WHEN 0 THEN 'urban' WHEN 1 THEN 'suburban' ELSE 'rural' END AS customer_location,
       value * 3 AS payment_amount,
       CASE k % 5 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'debit_card' WHEN 2 THEN 'mobile_money'
                  WHEN 3 THEN 'USSD' ELSE 'bank_transfer' END AS payment_method,
       CASE event_id % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'web' WHEN 2 THEN 'pos' ELSE 'atm' END AS device_type,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(20 + 2 * k AS DOUBLE) + value / 10 END AS network_latency,
       CASE WHEN bad = 1 THEN 'failure' ELSE 'success' END AS result,
       concat('PROC00', CAST(CAST(floor(k / 20.0) AS INT) + 1 AS VARCHAR)) AS processor_id,
       CASE WHEN bad = 1 THEN concat('E', lpad(CAST(k % 10 + 1 AS VARCHAR), 3, '0')) END AS error_code,
       CAST(CASE WHEN bad = 1 THEN k % 5 ELSE 0 END AS INTEGER) AS retry_count
FROM t)"""

ERR_CTE = """error_dim AS (SELECT * FROM (VALUES
  ('E001', 'Insufficient funds'), ('E002', 'Network timeout'), ('E003', 'Invalid account'),
  ('E004', 'Suspected fraud'), ('E005', 'Card expired'), ('E006', 'Payment declined'),
  ('E007', 'Processing error'), ('E008', 'Authentication failed'),
  ('E009', 'Transaction limit exceeded'), ('E010', 'System unavailable')) v(error_code, failure_reason)),
txr AS (SELECT t.*, d.failure_reason FROM transactions t LEFT JOIN error_dim d USING (error_code))"""

SALES_CTE = """sales AS (
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS txn_ts, l_suppkey AS merchant_key, o_custkey AS customer_key,
       r_name AS customer_location, l_extendedprice AS payment_amount, o_orderpriority AS payment_method,
       s_nationkey AS processor_key, CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END AS result
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey)"""

FEEDBACK_CTE = """feedback AS (
SELECT transaction_id, txn_ts, result = 'success' AS actual_success,
       0.98 - 0.003 * coalesce(network_latency, 100.0) AS prediction_probability
FROM transactions)"""

LOG_CTE = """request_log AS (
SELECT event_id, ts, value / 100 AS response_time_s,
       CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, props AS message
FROM events)"""

FAIL = "CASE WHEN result IN ('failure', 'failed') THEN 1 WHEN result = 'success' THEN 0 END"
OK = "CASE WHEN result = 'success' THEN 1 WHEN result IN ('failure', 'failed') THEN 0 END"


def txn_sql(body: str, *ctes: str) -> str:
    """``WITH <transactions>[, more CTEs] <body>``."""
    parts = [TXN_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def sales_sql(body: str, *ctes: str) -> str:
    parts = [SALES_CTE, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body
