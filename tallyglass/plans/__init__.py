"""Named queries over the shared test tables, each with its SQL check."""

from __future__ import annotations


def load():
    """All queries and their SQL, by name."""
    from tallyglass.plans import base, documents, news, search, sheets  # noqa: F401

    return dict(base.QUERIES), dict(base.ORACLES)
