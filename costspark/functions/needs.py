"""Declares which billing columns an operator reads."""

from __future__ import annotations

from collections.abc import Callable


def needs(*columns: str) -> Callable:
    """Attach ``fn.columns``.

    A caller that builds its billing table from joins can leave out the joins
    that only serve columns nobody reads; Catalyst cannot drop an inner join.
    """
    def mark(fn):
        fn.columns = columns
        return fn

    return mark
