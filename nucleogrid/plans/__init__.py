"""Chains of operators, the adapters of the driver's tables and the query catalogue."""
