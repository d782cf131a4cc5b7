"""Registered queries over the given tables."""


def load():
    """The registry with every query module imported."""
    from . import archive_queries, registry, work_queries  # noqa: F401
    return registry
