"""Training-data operators over text and vector tables. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Python workers get the code with the task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
