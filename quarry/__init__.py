"""quarry: retrieval analytics, document-version analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy of this package
