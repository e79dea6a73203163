"""Training-data operators: quality, language, personal data, toxicity, page text, decontamination, mixing,
near-duplicates, sharding and media columns.

Nothing outside this subpackage imports it; it can be removed without touching the event-log engine.
"""

import sys

from pyspark import cloudpickle

# Functions for executors travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
