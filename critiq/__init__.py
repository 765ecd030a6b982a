"""critiq - review analytics as Spark jobs."""
