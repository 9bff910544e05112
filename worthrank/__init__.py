"""worthrank: check-worthiness ranking, validation and evaluation on Spark DataFrames.

Sub-packages:

* ``sources``   - readers for transcripts, tweets, debate sentences, rankings; test-data views
* ``sinks``     - ranking writers, per-document split output, run log
* ``functions`` - Column-level scalar helpers (formats, rounding, softmax, vectors)
* ``operators`` - ranking scan, IR metrics, classification metrics, validation, preparation, models
* ``streaming`` - stream scoring and windowed counts
* ``plans``     - the registered queries (Spark side and DuckDB oracle SQL)
"""

__version__ = "0.1.0"
