"""Training-data operators (tokenising, filtering, deduplication, WARC, chat).

Nothing else in the library imports this subpackage.  Worker functions are
pickled by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
