"""lacuna: missing-data injection, imputation and scoring on Spark DataFrames."""

import sys as _sys

__version__ = "0.1.0"

try:  # ship our task-side functions (mapInPandas bodies) by value: executors need no install
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - pyspark absent or older cloudpickle
    pass
