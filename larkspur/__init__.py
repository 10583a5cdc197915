"""larkspur: a memory-retrieval and analytics engine written as Spark plans."""
