"""ledgerlens — general-ledger review on Spark.

Entry points: ``plans.review.review`` (the whole review as a fixed set of Spark passes),
``sources`` (CSV / parquet ledger readers, sinks), ``operators`` (each step of the
review as DataFrame functions) and ``python -m ledgerlens review`` (command line).
"""
__version__ = "0.1.0"
