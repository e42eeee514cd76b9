"""Schemas, the label rule and the small fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Canonical record schemas
# ---------------------------------------------------------------------------

#: Raw transaction record (F1).  ``hhmm`` is the raw ``HH:mm`` text and
#: ``day_name`` the weekday name; the derived 4-way bucket is ``time_of_day``.
TRANSACTION = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_location", T.StringType()),
    T.StructField("payment_amount", T.DoubleType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("network_latency", T.DoubleType()),
    T.StructField("result", T.StringType()),
    T.StructField("processor_id", T.StringType()),
    T.StructField("hhmm", T.StringType()),
    T.StructField("day_name", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("failure_reason", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("regional_event", T.StringType()),
])

#: Feedback record (F4).
FEEDBACK = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("actual_success", T.BooleanType()),
    T.StructField("prediction_probability", T.DoubleType()),
])

#: Scored record (F3).
SCORED = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("success_probability", T.DoubleType()),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("prediction_time", T.StringType()),
    T.StructField("model_version", T.StringType()),
])

#: A/B outcome record (F6).
AB_OUTCOME = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("predicted_probability", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("processing_time", T.DoubleType()),
])

#: Prediction request (F2): every field required.  Fixed values, in the record's own order.
_REQUEST_FIELDS = [
    ("transaction_id", "string"), ("timestamp", "string"), ("merchant_id", "string"), ("customer_id", "string"),
    ("customer_location", "string"), ("payment_amount", "double"), ("payment_method", "string"), ("device_type", "string"),
    ("network_latency", "double"), ("result", "string"), ("latency_bin_encoded", "int"), ("network_latency_scaled", "double"),
    ("merchant_rolling_avg_amount_scaled", "double"), ("merchant_success_rate_scaled", "double"),
    ("device_success_rate_scaled", "double"), ("payment_method_rolling_success_scaled", "double"),
    ("location_success_rate_scaled", "double"), ("payment_location_success_rate_scaled", "double"),
    ("merchant_transaction_count_log", "double"), ("hourly_transaction_volume_log", "double"), ("amount_log", "double"),
    ("merchant_rolling_avg_amount", "double"), ("hourly_transaction_volume", "int"), ("merchant_success_rate", "double"),
    ("time_of_day", "string"), ("latency_bin", "string"), ("day_name", "string"), ("amount_bin", "string"),
]
_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}
REQUEST = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in _REQUEST_FIELDS])

#: Request/response log line (monitoring input).
REQUEST_LOG = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("response_time_s", T.DoubleType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the studied project's for equal results.
# ---------------------------------------------------------------------------

#: Payment methods: (name, share of traffic, base failure rate).
PAYMENT_METHODS = [
    ("credit_card", 0.45, 0.05),
    ("debit_card", 0.30, 0.04),
    ("mobile_money", 0.15, 0.08),
    ("USSD", 0.07, 0.12),
    ("bank_transfer", 0.03, 0.03),
]

#: Error codes and their descriptions.
ERROR_CODES = [
    ("E001", "Insufficient funds"),
    ("E002", "Network timeout"),
    ("E003", "Invalid account"),
    ("E004", "Suspected fraud"),
    ("E005", "Card expired"),
    ("E006", "Payment declined"),
    ("E007", "Processing error"),
    ("E008", "Authentication failed"),
    ("E009", "Transaction limit exceeded"),
    ("E010", "System unavailable"),
]

#: Processors: (id, name, failure rate, average speed s, reliability).
PROCESSORS = [
    ("PROC001", "FastPay", 0.03, 1.2, 0.98),
    ("PROC002", "SecureTrans", 0.02, 1.8, 0.99),
    ("PROC003", "QuickMoney", 0.05, 0.9, 0.97),
    ("PROC004", "EasyProcess", 0.04, 1.5, 0.96),
    ("PROC005", "TrustPayments", 0.01, 2.0, 0.995),
]

#: Regional events of the studied generator:
#: (name, start, end, volume factor, failure factor), in priority order.
REGIONAL_EVENTS_2023 = [
    ("holiday_season", "2023-12-15", "2023-12-31", 1.5, 1.1),
    ("black_friday", "2023-11-24", "2023-11-26", 2.0, 1.2),
    ("cyber_monday", "2023-11-27", "2023-11-27", 1.8, 1.1),
    ("valentines_day", "2023-02-14", "2023-02-14", 1.3, 1.0),
]

#: Test calendar over the January 2024 test tables (overlap on 15-16 tests
#: first-match): (name, kind, start, end, methods, volume f., failure f.).
TEST_CALENDAR = [
    ("new_year", "regional", "2024-01-01", "2024-01-01", None, 1.3, 1.0),
    ("mid_month_sale", "regional", "2024-01-12", "2024-01-16", None, 1.5, 1.1),
    ("network_outage", "custom", "2024-01-15", "2024-01-17", ["mobile_money", "USSD"], 1.0, 3.0),
]

#: Hour-of-day failure factors of the risk rule: [lo, hi) -> factor.
HOUR_FACTORS = [(0, 6, 1.2), (6, 9, 1.1), (9, 17, 0.9), (17, 22, 1.0), (22, 24, 1.2)]
#: Weekday / weekend failure factors.
WEEKDAY_FACTOR, WEEKEND_FACTOR = 0.95, 1.05
#: Daily volume multipliers on weekdays / weekends.
WEEKDAY_VOLUME, WEEKEND_VOLUME = 1.2, 0.8

#: Fixed bin edges and labels.
AMOUNT_BIN_FIXED_EDGES = [0, 50, 100, 200, 300, 400, 500, 900]
AMOUNT_BIN_FIXED_LABELS = ["$0-50", "$50-100", "$100-200", "$200-300", "$300-400",
                           "$400-500", "$500-900"]
AMOUNT_BIN_OPEN_EDGES = [0, 50, 100, 200, 500, 1000]
AMOUNT_BIN_OPEN_LABELS = ["<$50", "$50-100", "$100-200", "$200-500", "$500-1000", ">$1000"]
AMOUNT_QBIN_LABELS = ["very_low", "low", "medium", "high", "very_high"]
LATENCY_QBIN_LABELS = ["low", "medium", "high", "very_high"]
TIME_OF_DAY = [(0, 6, "night"), (6, 12, "morning"), (12, 18, "afternoon"), (18, 24, "evening")]
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

#: Business thresholds.
SUCCESS_RATE_TARGET = 0.95
RESPONSE_TIME_TARGET_S = 0.5
P95_ALERT_S = 2.0
CALIBRATION_ERROR_LIMIT = 0.05
CALIBRATION_MIN_ROWS = 100
ERROR_COUNT_LIMIT = 10
ROUTE_THRESHOLD = 0.5


def dim_frames(spark):
    """The fixed dimensions as small DataFrames (safe to broadcast: their
    size does not grow with the data)."""
    pm = spark.createDataFrame(PAYMENT_METHODS, "payment_method string, traffic_share double, base_failure_rate double")
    err = spark.createDataFrame(ERROR_CODES, "error_code string, error_description string")
    proc = spark.createDataFrame(PROCESSORS, "processor_id string, processor_name string, "
                                             "processor_failure_rate double, avg_speed double, reliability double")
    return pm, err, proc


def calendar_frame(spark, rows=None):
    """Event calendar (F10) with a priority column: regional events first,
    then custom ones, each in list order."""
    rows = TEST_CALENDAR if rows is None else rows
    out = []
    for i, (name, kind, s, e, methods, vf, ff) in enumerate(rows):
        prio = (0 if kind == "regional" else 1000) + i
        out.append((name, kind, s, e, methods, float(vf), float(ff), prio))
    return spark.createDataFrame(out, "name string, kind string, start_date string, end_date string, "
                                      "affected_payment_methods array<string>, volume_factor double, "
                                      "failure_factor double, priority int") \
        .selectExpr("name", "kind", "CAST(start_date AS DATE) AS start_date", "CAST(end_date AS DATE) AS end_date",
                    "affected_payment_methods", "volume_factor", "failure_factor", "priority")

#: The model input of the studied project (fixed values).
MODEL_FEATURES = ["payment_method_rolling_success_scaled", "hour", "merchant_transaction_count_log",
                  "payment_location_success_rate_scaled", "amount_bin_encoded", "retry_count",
                  "payment_method_rolling_success", "merchant_success_rate_scaled", "network_latency_scaled",
                  "has_retry"]
