"""cadastra: listing resolution and clean-snapshot analytics as Spark jobs."""
