"""Training-data operators: jobs over the given tables.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guard in
``__spark_entry__.py``) imports it."""
import sys

from pyspark import cloudpickle

# functions of this folder travel to the executors by value: no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
