"""Readers, parsers as Spark jobs, validated inputs, and writers."""

from pyspark import cloudpickle

from claimgrove.sources import filings

# Functions run in Arrow batches travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(filings)
