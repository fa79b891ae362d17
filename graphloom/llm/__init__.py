"""Training-data operators: filtering, dedup, language ID, packing, search and export.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# workers get these functions whole and need not have the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
