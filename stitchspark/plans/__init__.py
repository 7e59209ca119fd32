"""Queries of the engine over the given tables."""

from importlib import import_module

from .registry import RUN, SQL, resolve

for _name in ("command_queries", "policy_queries", "selection_queries", "pixel_queries", "learning_queries"):
    import_module(f"{__name__}.{_name}")
resolve()

__all__ = ["RUN", "SQL"]
