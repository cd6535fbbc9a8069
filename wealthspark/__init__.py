"""wealthspark: DataFrame operators for wealth mapping from geospatial data, on Spark."""
