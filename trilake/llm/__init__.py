"""Operators for preparing training data; nothing else in the library imports them.

Their functions are sent to Python workers by value, so executors need no copy of the
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
