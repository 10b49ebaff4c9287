"""A bounded memory of function values, for the words of a text."""

from __future__ import annotations

from collections.abc import Callable

#: Letters or bytes of the longest words that are remembered: what is held is bounded in bytes, too.
LONG = 128


class Memo(dict):
    """key -> make(key), remembered in two generations: what was used since the last change of generations stays.

    Call trim() between documents; at most twice `size` values (and one document's) are held, none of a key above LONG.
    """

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.elder = make, size, {}

    def __missing__(self, key):
        if len(key) > LONG:
            return self.make(key)
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.elder = dict(self)
            self.clear()


class Known(dict):
    """key -> make(key), remembered until there are more than `size` at a trim(); then all is forgotten.

    For values that are cheap to make again: a miss asks one table, not two.
    """

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONG:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.clear()
