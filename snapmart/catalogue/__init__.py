"""Registered queries: every operator on the given tables, with its SQL twin.

A query is a function ``(spark, table_dir) -> DataFrame``; its SQL runs on views
of the same tables and gives the same columns and values.
"""

from importlib import import_module

MODULES = [
    "cleaning", "filters", "loan_queries", "join_queries", "aggregates",
    "profiles", "associations", "score_metrics", "snapshots", "models",
]


def load_all() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        import_module(f"snapmart.catalogue.{name}")
