"""omiclattice: multi-omics evidence operators as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Python helpers travel with each task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
