"""Structured Streaming variant of payload landing (IO3 + IO4 on a file stream)."""

from regiopanel.streaming.landing import land_payloads, payload_stream

__all__ = ["land_payloads", "payload_stream"]
