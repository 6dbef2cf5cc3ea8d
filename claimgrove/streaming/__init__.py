"""Structured Streaming twins of the event-shaped operators."""

from pyspark import cloudpickle

from claimgrove.streaming import streams

# State functions travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(streams)
