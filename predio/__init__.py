"""Property analytics on Spark: cleansing, search, scoring, geospatial joins, entity resolution and monitoring."""
