"""The registered queries in SQL, to check the engine's results against."""
