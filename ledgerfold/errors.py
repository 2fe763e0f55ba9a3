"""Errors of the log and of the fold."""


class KvError(Exception):
    """A log operation failed."""


class NotConnected(KvError):
    pass


class AlreadyExists(KvError):
    pass


class RevisionMismatch(KvError):
    pass


class WatchError(KvError):
    pass


class OperationFailed(KvError):
    pass


class CursorExpired(KvError):
    """The log no longer holds all changes after the cursor."""


class SnapshotError(Exception):
    """A fold, record log or artifact operation failed."""


class InvalidFormat(SnapshotError):
    pass


class Corrupted(SnapshotError):
    pass


class BackendError(SnapshotError):
    pass


class ArtifactInvalid(SnapshotError):
    pass
