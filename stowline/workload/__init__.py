"""Queries over the test tables: each pairs an operator with the SQL it must agree with."""

from importlib import import_module

MODULES = ("catalog_queries", "cloud_queries", "policy_queries", "plan_queries", "audit_queries", "stream_queries")


def load_all() -> None:
    """Import every query module once, which fills the registry."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
