"""netloom: network analysis over tables as Spark jobs."""

import sys

from pyspark import cloudpickle

# helpers used inside pandas functions travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
