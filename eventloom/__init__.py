"""Event-log and relational analytics written as Spark DataFrame programs."""
