"""Column-level building blocks (Column -> Column) and helpers on column names."""
