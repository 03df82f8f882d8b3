"""regiopanel: regional time-series panel analytics as PySpark DataFrame operators.

Layout
------
functions/  Column -> Column scalar expressions (number parsing, recoding, formatting)
sources/    readers and writers (delimited text, document collections, array payloads)
operators/  DataFrame -> DataFrame operators (schema, reshape, joins, aggregates, models, reports)
plans/      derived frames over the test tables and the registry of checked queries
streaming/  Structured Streaming variant of payload landing

Every operator is a plain function, so it composes with ``DataFrame.transform``.
"""

__version__ = "0.1.0"
