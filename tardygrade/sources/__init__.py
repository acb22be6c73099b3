"""Reading and writing tables, and the trip tables derived from the test data."""

from .tables import (
    drop_table,
    load_json,
    read_between,
    read_table,
    rows_frame,
    save_json,
    table_exists,
    table_path,
    table_profile,
    table_shapes,
    write_catalog_table,
    write_table,
)
from .trips import event_trips, trips
from .versions import current_path, identity

__all__ = [
    "current_path",
    "drop_table",
    "event_trips",
    "identity",
    "load_json",
    "read_between",
    "read_table",
    "rows_frame",
    "save_json",
    "table_exists",
    "table_path",
    "table_profile",
    "table_shapes",
    "trips",
    "write_catalog_table",
    "write_table",
]
