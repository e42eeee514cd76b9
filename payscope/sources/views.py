"""Derived views over the driver's test tables.

The test tables are not payment rows, so the canonical ``transactions``
view is derived from ``events`` and the larger ``sales`` view from the
lineitem star join.  Both are plain lazy DataFrames: Catalyst prunes the
columns a query does not use and pushes filters into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.functions import expr as X
from payscope.sources import schemas as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # event times are TIMESTAMP_NTZ; streaming watermarks and time buckets
    # cast them to TIMESTAMP, which is only wall-clock-preserving in UTC
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical transaction table (13 columns) derived from ``events``."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    e = e.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    bad = (F.col("event_type") == "error") | (F.col("k") >= 95)
    eid = F.col("event_id")
    method = (F.when(F.col("k") % 5 == 0, "credit_card").when(F.col("k") % 5 == 1, "debit_card")
              .when(F.col("k") % 5 == 2, "mobile_money").when(F.col("k") % 5 == 3, "USSD")
              .otherwise("bank_transfer"))
    return e.select(
        eid.alias("transaction_id"),
        F.col("ts").alias("txn_ts"),
        X.make_id("MERCH", F.col("user_id") + 1, 5).alias("merchant_id"),
        # ten customers for each thousand rows: the domain grows with the table
        X.make_id("CUST", F.floor(eid / 1000) * 10 + eid % 10 + 1, 6).alias("customer_id"),
        F.when(eid % 3 == 0, "urban").when(eid % 3 == 1, "suburban").otherwise("rural").alias("customer_location"),
        (F.col("value") * 3).alias("payment_amount"),
        method.alias("payment_method"),
        F.when(eid % 4 == 0, "mobile").when(eid % 4 == 1, "web").when(eid % 4 == 2, "pos")
         .otherwise("atm").alias("device_type"),
        F.when(eid % 97 == 0, F.lit(None).cast("double"))
         .otherwise((20 + 2 * F.col("k")).cast("double") + F.col("value") / 10).alias("network_latency"),
        F.when(bad, "failure").otherwise("success").alias("result"),
        F.concat(F.lit("PROC00"), (F.floor(F.col("k") / 20.0).cast("int") + 1).cast("string")).alias("processor_id"),
        F.when(bad, F.concat(F.lit("E"), F.lpad((F.col("k") % 10 + 1).cast("string"), 3, "0"))).alias("error_code"),
        F.when(bad, F.col("k") % 5).otherwise(0).alias("retry_count"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger payment-like table from the lineitem star join (scale work).

    The dimension sides (customer, nation, region, supplier) are joined by
    key; AQE turns them into broadcast joins when their measured size is
    under the threshold, and keeps shuffle joins when they are not.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, F.col("o_custkey") == c.c_custkey)
         .join(n, F.col("c_nationkey") == n.n_nationkey)
         .join(r, F.col("n_regionkey") == r.r_regionkey)
         .join(s, F.col("l_suppkey") == s.s_suppkey))
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_shipdate").alias("txn_ts"),
        F.col("l_suppkey").alias("merchant_key"),
        F.col("o_custkey").alias("customer_key"),
        F.col("r_name").alias("customer_location"),
        F.col("l_extendedprice").alias("payment_amount"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("s_nationkey").alias("processor_key"),
        F.when(F.col("l_returnflag") == "R", "failure").otherwise("success").alias("result"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback rows (F4): every transaction with its outcome and a
    latency-driven predicted probability."""
    t = transactions(spark, sf_dir)
    return t.select(
        "transaction_id", "txn_ts",
        (F.col("result") == "success").alias("actual_success"),
        (F.lit(0.98) - F.lit(0.003) * F.coalesce(F.col("network_latency"), F.lit(100.0))).alias("prediction_probability"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request/response log over ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts",
        (F.col("value") / 100).alias("response_time_s"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("props").alias("message"),
    )


def error_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.ERROR_CODES, "error_code string, failure_reason string")


def processor_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.PROCESSORS, "processor_id string, processor_name string, "
                                               "processor_failure_rate double, avg_speed double, reliability double")


def payment_method_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.PAYMENT_METHODS,
                                 "payment_method string, traffic_share double, base_failure_rate double")


def event_calendar(spark: SparkSession, rows=None) -> DataFrame:
    return S.calendar_frame(spark, rows)
