"""tessera: hybrid retrieval and knowledge-corpus analytics on PySpark DataFrames."""
