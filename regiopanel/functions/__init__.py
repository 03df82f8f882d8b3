"""Column -> Column scalar functions."""

from regiopanel.functions.locale import (
    NULL_MARKERS,
    format_decimal,
    locale_number,
    null_markers,
    separator_swap,
    trim_spaces,
    try_double,
    year_int,
)
from regiopanel.functions.recode import REGION_MAP, mapping_frame, parse_timestamp, recode, recode_join, recode_values

__all__ = [
    "NULL_MARKERS", "REGION_MAP", "format_decimal", "locale_number", "mapping_frame", "null_markers",
    "parse_timestamp", "recode", "recode_join", "recode_values", "separator_swap", "trim_spaces", "try_double", "year_int",
]
