"""fathomlab: a Spark-native laboratory for disciplined research on event-like observations."""
