"""DataFrame -> DataFrame operators."""

from pyspark import cloudpickle

from claimgrove.operators import claims, fusion, layout, search

# Functions run in Arrow batches travel by value, so executors need no installed copy.
for _module in (claims, fusion, layout, search):
    cloudpickle.register_pickle_by_value(_module)
