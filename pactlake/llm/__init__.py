"""Operators for building training data from documents, pages and conversations."""

import sys

from pyspark import cloudpickle

# Python tasks carry their code with them, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
