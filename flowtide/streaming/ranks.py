"""Running percentile ranks from a Fenwick tree of counts, in pages that are read and written alone."""

from __future__ import annotations

from collections.abc import Callable, Mapping

#: Counts in a page.
PAGE = 256


class Ranks:
    """Counts of values in equal bins of [0, 1]; adding a value and ranking one touch a few pages.

    ``read`` gives a page's counts or None; ``dirty`` names the pages that have changed since they were read.
    """

    def __init__(self, bins: int, total: int = 0, read: Callable[[int], list[int] | None] | None = None):
        self.bins, self.total = bins, total
        self._read = read or (lambda page: None)
        self.pages: dict[int, list[int]] = {}
        self.dirty: set[int] = set()

    @classmethod
    def of(cls, bins: int, total: int, pages: Mapping[int, list[int]]) -> Ranks:
        return cls(bins, total, lambda page: list(pages[page]) if page in pages else None)

    def bin_of(self, value: float) -> int:
        """The bin of a value; what is below 0, or no number, goes to the first, what is above 1 to the last."""
        scaled = value * self.bins
        return min(int(scaled), self.bins - 1) if scaled > 0 else 0

    def _page(self, number: int) -> list[int]:
        if number not in self.pages:
            self.pages[number] = self._read(number) or [0] * PAGE
        return self.pages[number]

    def add(self, value: float) -> None:
        self.total += 1
        node = self.bin_of(value) + 1
        while node <= self.bins:
            page = node // PAGE
            self._page(page)[node % PAGE] += 1
            self.dirty.add(page)
            node += node & -node

    def at_or_below(self, value: float) -> int:
        """How many values lie in the value's bin or a lower one."""
        node, count = self.bin_of(value) + 1, 0
        while node > 0:
            count += self._page(node // PAGE)[node % PAGE]
            node -= node & -node
        return count

    def observe(self, value: float) -> float:
        """Adds a value; returns the share of all values so far, itself included, that rank at or below it."""
        self.add(value)
        return self.at_or_below(value) / self.total
