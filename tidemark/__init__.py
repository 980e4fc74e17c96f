"""News-trend analytics over ranked, repeatedly polled item lists, as Spark plans."""
