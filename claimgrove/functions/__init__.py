"""Column -> Column functions."""

from pyspark import cloudpickle

from claimgrove.functions import arrays, canonical, geometry, numbers, periods, text

# Arrow functions travel by value, so executors need no installed copy.
for _module in (canonical, numbers, text):
    cloudpickle.register_pickle_by_value(_module)

__all__ = ["arrays", "canonical", "geometry", "numbers", "periods", "text"]
