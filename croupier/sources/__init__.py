from croupier.sources.driver_tables import RawTables, load_raw_tables, read_table  # noqa: F401
