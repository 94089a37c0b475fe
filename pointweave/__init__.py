"""Point-cloud and spatial analytics as Spark DataFrame plans."""
