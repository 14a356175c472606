"""Operators of a training-data pipeline over tables of documents and vectors.

Python functions of this library travel to the executors by value, so a cluster needs no
installation of it.
"""

from pyspark import cloudpickle

import catalogspark

cloudpickle.register_pickle_by_value(catalogspark)
