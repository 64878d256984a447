"""Registered queries, each with its SQL twin where one exists."""

from importlib import import_module

MODULES = (
    "row_queries", "key_queries", "join_queries", "aggregate_queries", "source_queries",
    "layer_queries", "feature_queries", "late_queries", "stream_queries", "quality_queries",
    "profile_queries",
)


def _load():
    for name in MODULES:
        import_module(f"smeltry.catalog.{name}")
    return import_module("smeltry.catalog.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
