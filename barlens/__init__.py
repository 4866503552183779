"""Event study and swing analytics for daily bars, as Spark DataFrame transformations."""
