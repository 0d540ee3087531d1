"""Corpus preparation operators for training data, one module per operator.

Nothing outside this subpackage imports it. Python workers receive its code with
the task (pickled by value), so executors need no installation of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
