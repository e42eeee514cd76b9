"""payscope: payment-transaction analytics as lazy Spark DataFrame operators.

Layout
------
sources/    schemas, derived views over the test tables, readers and writers
functions/  column expressions (labels, time parts, bins, hashing) and p-values
operators/  DataFrame -> DataFrame operators: profiling, cleaning, features,
            reports, statistics, ML, routing, monitoring
plans/      the named query catalogue and its DuckDB oracle SQL
streaming/  Structured Streaming versions of scoring, feedback, drift, errors
"""

from payscope.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
