"""siftwise: text-relevance analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (or returns a small
bounded result such as a fitted vocabulary table).  Nothing is collected to the
driver except scalars and lists whose size is bounded by configuration (model
names, ensemble combinations, grid points).
"""

import sys as _sys

# Python functions shipped to executors (encoders, scorers, UDF bodies) are
# pickled by value, so workers need no copy of this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001  (older cloudpickle: ship the package with --py-files)
    pass

__all__ = ["session", "config"]
