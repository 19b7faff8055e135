

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, as a worker may not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
