"""Article intelligence on Spark: ingest, de-duplicate, chunk, embed, index, retrieve and answer."""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
