"""Sources and sinks: parquet/CSV/JSON IO, role binding of the given tables, corpus assembly."""
