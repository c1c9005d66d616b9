"""Operators of a training-data pipeline over a table of documents or pages; nothing else in the package imports them."""
