"""Shelfwatch: catalog change detection and market comparison as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
