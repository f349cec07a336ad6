"""Column factories: every function takes and returns Columns (or plain Python configuration)."""
