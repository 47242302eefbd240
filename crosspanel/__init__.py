"""Cross-sectional panel analytics expressed as Spark DataFrame operators.

Layout: ``sources`` read and write, ``functions`` are column-level helpers,
``operators`` transform long (entity x date) tables, ``plans`` chain operators
into whole pipelines and into the registered queries.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run in Python workers travel inside the job, so
# executors need no installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
