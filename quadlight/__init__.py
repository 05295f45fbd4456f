"""quadlight: SPARQL analytics over RDF quads and Parquet tables, compiled to PySpark DataFrames."""
