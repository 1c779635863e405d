"""Results that are pulled row by row."""
