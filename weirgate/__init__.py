"""weirgate: PySpark-native analytics for the traffic between applications and language models.

Functions that run inside Python tasks are pickled by value, so that executors need no copy of this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
