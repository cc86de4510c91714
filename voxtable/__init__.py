"""Chunked-volume, mesh, raster and evaluation analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the plan, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
