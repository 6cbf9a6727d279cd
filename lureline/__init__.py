"""lureline: campaign-interaction analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function written with the
public PySpark API. Sub-packages:

* ``sources``   -- fixture tables derived from the driver's parquet, file scans and sinks
* ``functions`` -- column expressions (rates, JSON signal flags, hashing draws, text cleanup)
* ``operators`` -- facts, summaries, attribution, design, synthetic cohorts, evaluation, models
* ``streaming`` -- Structured Streaming attribution and running counters
* ``plans``     -- the query registry used by ``__spark_entry__`` and ``bench.py``
"""

__version__ = "0.1.0"
