"""Operators of a training-data pipeline, with their queries in ``queries.py``. Nothing else in the library imports this."""
