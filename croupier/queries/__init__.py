"""Dashboard KPI queries: one function per query, ``(warehouse, scope, ...) -> DataFrame``."""
