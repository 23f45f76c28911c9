"""tessera: record-collection, ranking and reporting operators as Spark plans."""
