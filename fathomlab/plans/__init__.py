"""What is decided before a plan reaches Spark: predicates, their text language, guards, plugins."""
