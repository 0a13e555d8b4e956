"""Document analytics on Spark: objects, sections, chunks, specification items, search, quality reports, exports."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
