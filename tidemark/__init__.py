"""tidemark: Spark-first analytics for geolocated observations."""
