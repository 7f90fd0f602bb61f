"""quire: a PySpark-native engine for turning long documents into planned,
indexed and verified study material.  Every operator is DataFrame -> DataFrame
with a book key, so all books run in parallel."""

__version__ = "0.1.0"
