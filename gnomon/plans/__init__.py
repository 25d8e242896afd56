"""Named queries: how they are built on Spark and what they mean in SQL."""
