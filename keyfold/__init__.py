"""keyfold: keyed aggregation and text analytics as lazy Spark DataFrame plans."""
