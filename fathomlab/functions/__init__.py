"""Column functions: calendar, statistics, random numbers."""
