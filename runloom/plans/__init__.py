"""Control-plane views over stored tables, and the queries that are registered on them."""
