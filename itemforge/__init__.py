"""itemforge: Spark jobs that build, enrich, summarise and query a bank of text items."""
