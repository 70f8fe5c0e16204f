"""cohortwise: listing ingest, cleaning, enrichment and cohort ranking as Spark jobs.

Every public function takes and returns DataFrames (or Columns, in
``cohortwise.functions``); nothing is collected to the driver.
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
