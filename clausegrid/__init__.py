"""clausegrid: treaty-clause analytics expressed as Spark DataFrame jobs.

Functions of this package travel to the Python workers by value, so workers need neither the
package nor the driver's working directory.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
