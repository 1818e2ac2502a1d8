"""The jobs over sample tables, each with an independent SQL statement of its result."""
