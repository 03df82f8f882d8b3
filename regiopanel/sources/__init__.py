"""Readers and writers."""

from regiopanel.sources.collection import (
    append_to_collection,
    apply_projection,
    collection_scan,
    query_to_column,
    ragged_union,
    stringify_id,
)
from regiopanel.sources.delimited import (
    DEFAULT_NA_VALUES,
    apply_locale_types,
    export_csv,
    infer_locale_types,
    load_locale_csv,
    read_delimited,
    read_export,
    save_decimal_csv,
)
from regiopanel.sources.payload import payload_dict_rows, payload_rows, payload_schema, read_payloads
from regiopanel.sources.typed_json import decode_typed_json, read_document_dump

__all__ = [
    "DEFAULT_NA_VALUES", "append_to_collection", "apply_locale_types", "apply_projection",
    "collection_scan", "decode_typed_json", "export_csv", "infer_locale_types", "load_locale_csv",
    "payload_dict_rows", "payload_rows", "payload_schema", "query_to_column", "ragged_union", "read_delimited",
    "read_document_dump", "read_export", "read_payloads", "save_decimal_csv", "stringify_id",
]
