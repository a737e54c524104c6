"""Operators for building training corpora.

Nothing else in the library imports this package.  Functions that run in Python workers are pickled by
value, so executors need numpy, pyarrow and the tokenizer libraries but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
