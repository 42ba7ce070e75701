"""Named user queries and the queries checked against SQL."""
