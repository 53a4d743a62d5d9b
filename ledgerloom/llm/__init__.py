"""Training-data operators: filters, scans, tokenizing, search, deduplication, classifiers and scoring.

Nothing outside this package imports it.  Every operator takes and returns DataFrames and
leaves partitioning, shuffles and recovery to Spark; Python code runs inside tasks on Arrow
batches of bounded size.
"""
