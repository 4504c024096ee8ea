"""ballast: dependency-cost analytics as Spark DataFrame jobs."""
