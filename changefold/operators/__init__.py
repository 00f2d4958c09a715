"""DataFrame operators on change logs."""
