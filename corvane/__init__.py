"""corvane: corpus ingest, retrieval and run analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions shipped to Python workers carry their code along, so that executors need
# no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
