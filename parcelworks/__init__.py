"""parcelworks: record quality, ledgers and register reads as Spark jobs."""
