"""DataFrame to DataFrame operators over all runs at a time."""
