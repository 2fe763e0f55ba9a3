"""At most one exporter a round: a lease in a bucket, won by compare and swap, with its expiry in the value."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import asdict, dataclass, replace

from ledgerfold.errors import AlreadyExists, KvError, RevisionMismatch
from ledgerfold.kernels import cursor_hex
from ledgerfold.sources.log import Bucket

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class LeaseRecord:
    holder_id: str
    acquired_at_unix: int
    expires_at_unix: int
    completed_cursor_hex: str | None = None
    completed_at_unix: int | None = None

    def dump(self) -> bytes:
        return json.dumps({k: v for k, v in asdict(self).items() if v is not None}).encode()

    @staticmethod
    def parse(raw: bytes) -> LeaseRecord | None:
        """None for anything that is not a lease."""
        try:
            d = LeaseRecord(**json.loads(raw))
            return d if isinstance(d.expires_at_unix, int) else None
        except (ValueError, TypeError):
            return None


class LeaseGuard:
    """The held round: end it with complete() or abandon(). As a context manager it logs if neither was called."""

    def __init__(self, lease: Lease, record: LeaseRecord, version: int):
        self.lease, self.record, self.version, self.resolved = lease, record, version, False

    def complete(self, cursor: int | None) -> None:
        """Note the exported cursor; the expiry stays, so the round runs its full time."""
        self.resolved = True
        done = replace(self.record, completed_cursor_hex=cursor_hex(cursor), completed_at_unix=int(self.lease.clock()))
        try:
            self.lease.bucket.update(self.lease.key, done.dump(), self.version)
        except RevisionMismatch:
            log.warning("export lease %s was taken over before the round completed", self.lease.key)

    def abandon(self) -> None:
        """Open the round again at once."""
        self.resolved = True
        try:
            self.lease.bucket.delete_with_version(self.lease.key, self.version)
        except KvError as e:
            log.warning("export lease %s stays until it expires: %s", self.lease.key, e)

    def __enter__(self) -> LeaseGuard:
        return self

    def __exit__(self, *_) -> None:
        if not self.resolved:
            log.warning("export lease %s was neither completed nor abandoned; the round waits out its time", self.lease.key)


class Lease:
    def __init__(self, bucket: Bucket, key: str, holder_id: str, clock=time.time):
        self.bucket, self.key, self.holder_id, self.clock = bucket, key, holder_id, clock

    def try_acquire(self, ttl_s: int) -> LeaseGuard | None:
        """The guard for the one winner of the round, None for all others.

        The key's last put says whose round it is: none, or one that is over,
        abandoned or unreadable, may be followed. Writing against exactly that
        state makes one of several followers the winner.
        """
        now = int(self.clock())
        last = self.bucket.entry(self.key)  # shows the empty value of an abandoned lease too
        held = LeaseRecord.parse(last.value) if last else None
        if held is not None and held.expires_at_unix > now:
            return None
        mine = LeaseRecord(self.holder_id, now, now + ttl_s)
        try:
            version = self.bucket.update(self.key, mine.dump(), last.revision) if last else self.bucket.create(self.key, mine.dump())
        except (AlreadyExists, RevisionMismatch):
            return None
        return LeaseGuard(self, mine, version)

    def current(self) -> LeaseRecord | None:
        found = self.bucket.get(self.key)
        return LeaseRecord.parse(found.value) if found else None
