"""Training-data operators: dedup, filtering, search, extraction, packing.

Each module holds one operator over DataFrames with its general interface;
``queries`` registers the thin ``opN_<name>`` queries. Functions sent to the
Python workers are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
