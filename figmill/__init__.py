"""figmill: a PySpark engine that turns layout primitives and figure records into queryable evidence tables."""
