"""papyra: document-knowledge analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers bring their code along, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
