"""clientele: customer-analytics operators on Spark DataFrames.

Every public operator takes DataFrames (plus column names and parameters) and
returns a DataFrame; nothing is collected to the driver except bounded
metadata (schemas, model trees, a handful of quantile values).
"""

__version__ = "0.1.0"
