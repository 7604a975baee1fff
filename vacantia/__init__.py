"""Posting analytics on Spark: parse, mine, score, de-duplicate, merge and serve postings."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the job, so executors need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
