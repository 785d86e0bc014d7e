"""corpusloom: corpus indexing and hybrid retrieval expressed as Spark plans."""
