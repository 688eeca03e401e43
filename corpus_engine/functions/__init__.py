"""Column-level building blocks: every function takes and returns Columns."""
