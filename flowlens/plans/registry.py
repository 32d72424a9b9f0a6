"""Import every catalog module and expose the merged registry."""

from __future__ import annotations

from . import catalog


def all_queries() -> dict:
    # importing the modules registers their queries
    from . import catalog_more, catalog_stream  # noqa: F401

    return dict(catalog.REGISTRY)
