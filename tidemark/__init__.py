"""tidemark: a Spark-first engine for daily physiological series and the tables around them."""
