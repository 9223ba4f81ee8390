"""docmill: product-document analytics as Spark DataFrame transforms."""
import sys

from pyspark.cloudpickle import register_pickle_by_value

# ship the small Python helpers with the job; executors need no installed copy
register_pickle_by_value(sys.modules[__name__])
