"""pageloom: document analytics as Spark plans.

Paged documents are chunked, searched, summarised and checked with DataFrame
and SQL plans; Python runs only for sequential folds, binary formats and the
pluggable embedding and text-generation boundaries.
"""

import sys

from pyspark import cloudpickle

# Functions handed to Arrow workers are pickled by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
