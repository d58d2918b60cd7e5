"""billcov: bill passage and news coverage analytics on Spark DataFrames.

Functions take and return DataFrames; no global session is kept.  Sub-packages:

* ``sources``   – table readers, fixture views, sinks and resume logic
* ``functions`` – column-level helpers (text cleanup, rounding, flags)
* ``operators`` – the table operators (features, matching, extraction, models)
* ``plans``     – end-to-end jobs that chain operators (model table, collection)
* ``streaming`` – incremental article extraction with Structured Streaming
"""

__version__ = "0.1.0"
