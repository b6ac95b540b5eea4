"""Training-data operators.  Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Workers unpickle the kernels themselves, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
