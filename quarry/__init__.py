"""quarry: text retrieval and evaluation as Spark DataFrame functions.

Every public function takes and returns DataFrames (or Columns); nothing
holds state between calls.  Sub-packages:

* ``functions``  – Column-level text functions (cleaning, tokens, counts).
* ``sources``    – readers and writers (JSON splits, driver tables, runs).
* ``operators``  – relational building blocks: collection, index,
  retrieval, keywords, dense, re-ranking, evaluation, answering.
* ``plans``      – named experiment pipelines and the query registry.
"""

__version__ = "0.1.0"

# Functions of this package run inside Python UDFs and mapInPandas tasks.
# Pickle them by value so executors need no installed copy of the package.
try:  # pragma: no cover - depends on the PySpark build
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
