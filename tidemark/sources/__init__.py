from .conform import conform, quarantine, schema_from
from .files import detect_format, header_lines, load_by_header, load_directory, load_file
from .loads import content_key, create_loaded_table, load_once
from .tables import (
    append_table,
    create_database,
    create_table,
    describe,
    drop_table,
    inventory_listing,
    overwrite_partitions,
    overwrite_table_partitions,
    preview,
    register_file,
    schema_overview,
    verify,
)

__all__ = [
    "append_table",
    "conform",
    "content_key",
    "create_database",
    "create_loaded_table",
    "create_table",
    "describe",
    "detect_format",
    "drop_table",
    "header_lines",
    "inventory_listing",
    "load_by_header",
    "load_directory",
    "load_file",
    "load_once",
    "overwrite_partitions",
    "overwrite_table_partitions",
    "preview",
    "quarantine",
    "register_file",
    "schema_from",
    "schema_overview",
    "verify",
]
