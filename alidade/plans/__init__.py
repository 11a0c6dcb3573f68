"""Fixtures, registered queries with their SQL, the command session."""
