"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Its Python functions are
shipped to the executors by value, so executors need numpy, pandas and pyarrow
but no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
