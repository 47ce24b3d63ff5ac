"""vigilmill: drug-safety text mining on Spark DataFrames.

Layout: ``functions`` (Column to Column), ``operators`` (DataFrame to
DataFrame), ``sources`` and ``streaming`` (in and out), ``plans`` (the query
catalogue and its SQL counterparts), ``llm`` (training-text operators; nothing
outside that subpackage imports it).
"""

__version__ = "0.1.0"

try:
    from pyspark.cloudpickle import register_pickle_by_value as _by_value
    import sys as _sys

    # Python workers get our functions with the plan; no executor needs the package on its path.
    _by_value(_sys.modules[__name__])
except ImportError:  # without PySpark only the pure-Python parts work
    pass
