"""Mail and document analytics as Spark jobs."""
