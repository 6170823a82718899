"""Collection-to-knowledge operators as Spark DataFrame programs."""
