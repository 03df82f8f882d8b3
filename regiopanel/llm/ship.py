"""What executors need besides the data: this package, and the bytes of tokenizer files.

Tokenizer files (1 to 2 MB) are read where the driver runs and broadcast, so no executor needs the path.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession

from regiopanel.shipping import ship

__all__ = ["received", "send_file", "ship"]


def send_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a tokenizer file for the executors, with their digest."""
    ship(spark)
    raw = Path(path).read_bytes()
    return spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


class _Sent:
    """Bytes that compare by their digest, so that workers build a tokenizer once for each file."""

    def __init__(self, digest: str, raw: bytes):
        self.digest, self.raw = digest, raw

    def __hash__(self):
        return hash(self.digest)

    def __eq__(self, other):
        return self.digest == other.digest


@lru_cache(maxsize=4)
def _build(kind, sent: _Sent):
    return kind(sent.raw)


def received(kind, sent: Broadcast):
    """``kind(bytes of the file)``, built once in each Python worker."""
    return _build(kind, _Sent(*sent.value))
