"""Operators for training-data pipelines: extraction, filters, scores, near duplicates, packing, tokens.

The functions of this package travel with their tasks, so executors need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
