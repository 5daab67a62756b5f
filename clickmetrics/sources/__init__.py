"""Loading web tables (Parquet, CSV), the events adapter, and table sinks."""

from clickmetrics.sources.events import load_from_events, web_tables_from_events
from clickmetrics.sources.sink import browse, materialize, save_table, use_database
from clickmetrics.sources.tables import WebTables, load_database, load_web_tables, read_table

__all__ = ["WebTables", "load_database", "load_web_tables", "read_table", "load_from_events",
           "web_tables_from_events", "save_table", "materialize", "use_database", "browse"]
