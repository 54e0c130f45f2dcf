"""Streaming ingest of documents.

The reference has no streaming operator. The token chain and the per-document
counts are narrow row-wise projections, so they apply unchanged to a
streaming DataFrame of documents; ``ingest`` wires a file-source stream into
the same functions and appends the long counts to a table that the batch
operators then read (``operators.dfm.dfm_from_long``).
"""
