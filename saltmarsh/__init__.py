"""Saltmarsh: sales, document and news analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrame to DataFrame (or Column to
Column). Nothing here creates a session; callers bring their own.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
