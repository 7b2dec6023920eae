"""Training-data operators. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their module's code along, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
