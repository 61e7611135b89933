"""Training-data operators: search, sharding, WARC, dedup, scoring, mixing and packing.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""

from pyspark import cloudpickle

import tidemark.llm as _self

# Functions that run on executors travel by value, so workers need not have this repository on their path.
cloudpickle.register_pickle_by_value(_self)
