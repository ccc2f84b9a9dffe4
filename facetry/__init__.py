"""Surface analytics on Spark: atoms, meshes, patches, fingerprints, poses and designs as DataFrames."""


import sys

from pyspark import cloudpickle

# functions of the package travel with the tasks, so workers need not be able to import it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
