"""Market-comps analytics on Spark: extraction, normalization, merging, price bands, alerts."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so a cluster needs no
# separate installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
