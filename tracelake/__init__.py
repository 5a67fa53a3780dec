"""tracelake: change-impact analytics over document and case corpora, on PySpark."""
