"""newsloom: story extraction and feed analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel inside the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
