"""Column -> Column geometry."""
