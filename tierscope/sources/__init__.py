from tierscope.sources.base_table import (conform, load_base_table, read_base_table,
                                         read_base_table_jdbc, write_base_table)
from tierscope.sources.fixture import derive_base_table
from tierscope.sources.schema import BASE_SCHEMA, COLUMNS, TABLE_NAME

__all__ = ["BASE_SCHEMA", "COLUMNS", "TABLE_NAME", "conform", "derive_base_table",
           "load_base_table", "read_base_table", "read_base_table_jdbc", "write_base_table"]
