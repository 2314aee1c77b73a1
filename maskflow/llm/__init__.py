"""Operators for preparing training text: mixing, scans, near duplicates, scoring, packing.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
