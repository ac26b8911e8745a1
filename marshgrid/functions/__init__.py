"""Column factories: every function maps Columns to a Column."""
