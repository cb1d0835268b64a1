"""quillon: source-corpus and tree analytics, declared as Spark DataFrames."""
