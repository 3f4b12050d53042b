"""locusflow: haplotype analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the code with the task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
