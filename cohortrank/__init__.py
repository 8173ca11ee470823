"""cohortrank: peer-group scoring and table-quality operators on Spark DataFrames.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects (or
``Column`` expressions) and leaves physical planning to Catalyst and AQE.
"""

__version__ = "0.1.0"
