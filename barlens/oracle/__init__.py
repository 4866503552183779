"""Independent SQL for checking the queries with another engine."""
