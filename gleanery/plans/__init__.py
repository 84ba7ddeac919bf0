"""Multi-step plans and the registry of queries with their SQL."""
