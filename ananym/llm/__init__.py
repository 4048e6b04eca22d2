"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it. Its functions travel to executors by value, so that executors
need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
