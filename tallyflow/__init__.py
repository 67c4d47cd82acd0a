"""tallyflow: ledger analytics and training-data operators as Spark plans.

Functions that run on executors are pickled by value, so the package needs no
installation there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
