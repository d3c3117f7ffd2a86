"""umbral: discontinuity analytics, record linkage and zonal statistics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors get the small solver functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
