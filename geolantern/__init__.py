"""Geo-semantic point-of-interest retrieval as Spark jobs.

Keyword, radius and vector top-k search over tables of tagged points, the
embedding jobs that feed it, and the evaluation that compares retrieval methods.
Every operator takes DataFrames and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with the task, so
# executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
