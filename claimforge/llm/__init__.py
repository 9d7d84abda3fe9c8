"""Training-data operators: archives, URLs, text extraction, mixing, decontamination, dedup, quality, scoring."""

import sys

from pyspark import cloudpickle

# The tasks' code travels with the job, so executors need no installed copy of this subpackage.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
