"""Ready-made data work on tables and streams, written as Spark DataFrame programs."""
