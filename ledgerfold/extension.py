"""What a log, a fold or a transport of one's own has to offer. Ours are made on these classes.

The engine asks for nothing else: the applied watch works on any KvWatcher and
SnapshotStore, the lease on any KvReader with a KvWriter, the export round on
any ArtifactTransport.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import DataFrame

from ledgerfold.errors import OperationFailed
from ledgerfold.functions.scope import Scope


class KvReader(ABC):
    """Reads of the log's live state."""

    @abstractmethod
    def get(self, key: str) -> Any | None:
        """The entry of a key with a value; empty values count as absent."""

    @abstractmethod
    def entry(self, key: str) -> Any | None:
        """The last put of a key, empty values included, as compare-and-swap needs their revision. No default: hiding them would be silent."""

    @abstractmethod
    def keys(self, scope: str | Scope = "") -> DataFrame: ...

    @abstractmethod
    def scan(self, scope: str | Scope = "") -> DataFrame: ...


class KvWriter(ABC):
    """Changes of the log."""

    @abstractmethod
    def put(self, key: str, value: bytes) -> int: ...

    @abstractmethod
    def delete(self, key: str) -> bool: ...

    @abstractmethod
    def create(self, key: str, value: bytes) -> int: ...

    @abstractmethod
    def update(self, key: str, value: bytes, expected: int | bytes) -> int: ...

    @abstractmethod
    def delete_with_version(self, key: str, expected: int | bytes) -> bool: ...

    @abstractmethod
    def purge(self, key: str) -> None: ...

    def put_with_ttl(self, key: str, value: bytes, ttl_s: int) -> int:
        """Refused unless a log has it."""
        raise OperationFailed("values with a time to live are not supported")


class KvWatcher(ABC):
    """The log as changes, in revision order."""

    @abstractmethod
    def watch(self, scope: Scope) -> DataFrame:
        """The last change of each key in the scope, markers included."""

    def watch_from(self, cursor: int | None, scope: Scope) -> DataFrame:
        """The changes after a cursor. By default the cursor is ignored: the whole state is a superset that folds to the same."""
        return self.watch(scope)


class SnapshotStore(ABC):
    """A durable fold: data and cursor become visible together."""

    @property
    @abstractmethod
    def cursor(self) -> int | None: ...

    @abstractmethod
    def apply(self, batch: DataFrame, cursor: int | None) -> None: ...

    @abstractmethod
    def rows(self, scope: str | Scope = "") -> DataFrame: ...

    @abstractmethod
    def refresh(self) -> Any: ...


class ArtifactTransport(ABC):
    """Ships artifacts; its pointer never goes back."""

    @abstractmethod
    def upload(self, folder: str, key: str) -> str: ...

    @abstractmethod
    def manifest(self, key: str) -> Any | None: ...

    @abstractmethod
    def download(self, key: str, dest: str) -> Any: ...

    def prune(self, key: str, grace_s: float) -> int:
        """Nothing to prune unless a transport keeps old payloads."""
        return 0
