"""Pipeline definitions and the views of the test tables."""
