"""ohmflow: electrical test readings on Spark.

Every public function takes and returns Spark DataFrames; nothing collects to
the driver.  Sub-packages:

* ``sources``   - file admission, CSV / preamble / JSON scans, synthetic series
* ``sinks``     - CSV / JSON / multi-frame writes, appends, batch upsert
* ``functions`` - column-level helpers (strict numeric parsing, aliases, ...)
* ``operators`` - quality rules, statistics, series windows, browsing,
                  relations, chart shapes, KPIs
* ``streaming`` - Structured Streaming alarms and tumbling means
* ``plans``     - the query catalogue over the driver's test tables
"""

__version__ = "0.1.0"
