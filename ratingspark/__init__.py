"""Rating prediction and model comparison on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: Arrow functions carry its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from ratingspark.session import build_session  # noqa: E402

__all__ = ["build_session"]
