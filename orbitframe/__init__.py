"""Earth-observation analytics over Spark tables: plain functions from DataFrame to DataFrame."""
