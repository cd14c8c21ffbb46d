"""Training-data operators: thirteen of them, each in modules of its own; ``queries`` registers them.

Functions of this package travel to the tasks by value, so a cluster needs no copy of it on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
