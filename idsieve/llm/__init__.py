"""Operators for training-data pipelines: DataFrame in, DataFrame out.

Nothing else in the library imports this subpackage. Each module holds one operator with its own
interface; ``queries`` applies them to the given tables.
"""

import sys

from pyspark import cloudpickle

# Python steps carry their code with them, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
