"""Watch scopes as predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """A union of key prefixes. No prefix is nothing; the empty prefix is everything.

    Prefixes are literal; end them at a token boundary (a dot) where a remote
    log matches whole tokens.
    """

    prefixes: tuple[str, ...] = ("",)

    @staticmethod
    def all() -> Scope:
        return Scope(("",))

    @staticmethod
    def prefix(p: str) -> Scope:
        return Scope((p,))

    @staticmethod
    def of(prefixes) -> Scope:
        return Scope(tuple(prefixes))

    @property
    def is_all(self) -> bool:
        return "" in self.prefixes

    def column(self, key: str = "key") -> Column:
        """Reaches Parquet as StringStartsWith."""
        if self.is_all:
            return F.lit(True)
        return reduce(lambda a, b: a | b, [F.col(key).startswith(p) for p in self.prefixes], F.lit(False))

    def holds(self, key: str) -> bool:
        return any(key.startswith(p) for p in self.prefixes)
