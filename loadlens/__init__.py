"""Analytics for event streams and for the telemetry of the jobs processing them."""

import sys

from pyspark import cloudpickle

# Functions reach Python workers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
