"""Training-data operators: packing, scoring, sharding, deduplication.

Nothing outside this subpackage imports it.  Functions that run on executors
are pickled by value, so the workers need only the installed libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
