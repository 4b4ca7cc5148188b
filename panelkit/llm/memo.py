"""A bounded table of computed values in two generations."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Memo:
    """Values of keys seen lately.

    When the young generation holds ``limit`` keys it becomes the old one; keys asked
    for again move back to the young one, so frequent keys stay and rare ones go.
    """

    def __init__(self, compute: Callable[[list], Iterable], limit: int) -> None:
        self.compute, self.limit = compute, limit
        self.young: dict = {}
        self.old: dict = {}

    def values(self, keys: set) -> dict:
        """A table that holds (at least) ``keys``, until the next call."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = []
        for key in keys.difference(young):
            value = old.get(key)
            if value is None:
                missing.append(key)
            else:
                young[key] = value
        young.update(zip(missing, self.compute(missing), strict=True))
        return young
