"""Conversation-archive analytics written with the Spark DataFrame API.

``functions``  Column expressions and the three Arrow UDFs
``sources``    readers for vendor stores, text exports, JSON and media files
``operators``  DataFrame-in / DataFrame-out jobs (canonicalise, query, resolve, maintain, check)
``streaming``  Structured Streaming jobs that reuse the operators per micro-batch
``plans``      the registered queries over the given tables, each with its check SQL
"""

__version__ = "0.1.0"
