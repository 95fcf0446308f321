"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Functions that run on executors are pickled by value, so the
executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["siltstone.llm"])
