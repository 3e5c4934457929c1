"""Example queries over the test tables; importing this package registers all of them."""

from keelson.catalog import diff, evolve, integrity, logs, streams, texts, transfer  # noqa: F401
from keelson.catalog.registry import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "Tables"]
