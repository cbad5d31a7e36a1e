"""Registered queries: the operators run over the driver's tables, each with the SQL that must agree."""
