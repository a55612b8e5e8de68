"""Operators of a training-data pipeline over documents, pages, embeddings and conversations.

Nothing else in the library imports this subpackage. Its functions are pickled by value, so executors need no copy
of the library on their own Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
