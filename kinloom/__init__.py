"""kinloom: entity resolution, data quality and corpus preparation on PySpark."""
