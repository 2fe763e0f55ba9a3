"""Column expressions of the engine: all inside whole-stage code generation, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.sources.schema import DEL, PURGE, PUT


def is_put(op: str = "op") -> Column:
    return F.col(op) == PUT


def is_live(op: str = "op", value: str = "value") -> Column:
    """A put with a value: what reads show. A put without one is a tombstone of compare-and-swap deletes."""
    return (F.col(op) == PUT) & (F.octet_length(F.col(value)) > 0)


def op_of_header(header: Column) -> Column:
    """Operation named by a message header; none means put. Other headers give NULL (not a change)."""
    return F.when(header.isNull() | (header == PUT), PUT).when(header == DEL, DEL).when(header == PURGE, PURGE)


def op_of_entry(operation: Column) -> Column:
    """Operation of an entry that a client library has decoded, by name in any case; other names give NULL."""
    name = F.upper(operation)
    return F.when(name == "PUT", PUT).when(name.isin("DEL", "DELETE"), DEL).when(name == "PURGE", PURGE)


def strip_keyspace(subject: Column, keyspace: str) -> Column:
    """Key of a subject inside the keyspace, else NULL."""
    return F.when(subject.startswith(keyspace), F.substring(subject, len(keyspace) + 1, 1 << 30))


def ack_sequence(reply: Column) -> Column:
    """Stream revision of a delivery subject: token 5 of nine, token 7 of more; NULL where it isn't one."""
    t = F.split(reply, r"\.")
    named = (F.get(t, F.lit(0)) == "$JS") & (F.get(t, F.lit(1)) == "ACK") & (F.size(t) >= 9)
    at = F.when(F.size(t) == 9, F.get(t, F.lit(5))).otherwise(F.get(t, F.lit(7)))
    return F.when(named & at.rlike("^[0-9]+$"), at.try_cast("bigint"))


def hex16(n: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(n)), 16, "0")


def from_hex16(text: Column) -> Column:
    return F.conv(text, 16, 10).try_cast("bigint")


def version_bytes(revision: Column) -> Column:
    """8 bytes big-endian, empty for an unknown revision."""
    return F.when(revision.isNull(), F.unhex(F.lit(""))).otherwise(F.unhex(F.lpad(F.hex(revision), 16, "0")))


def version_revision(version: Column) -> Column:
    """Revision of 8-byte versions; other versions stay opaque."""
    return F.when(F.octet_length(version) == 8, F.conv(F.hex(version), 16, 10).try_cast("bigint"))


def resume_ok(cursor: Column, first_sequence: Column) -> Column:
    return first_sequence <= F.coalesce(F.try_add(cursor, F.lit(1)), F.lit(9223372036854775807))


def gap_loss(frontier: Column, revision: Column, first_sequence: Column) -> Column:
    """Did delivery jump from the frontier over revisions that retention removed unseen?"""
    return (revision > frontier + 1) & ~resume_ok(frontier, first_sequence)


def publish_ok(existing: Column, candidate: Column) -> Column:
    """existing NULL: no pointer, or one that can't be read."""
    return existing.isNull() | (candidate >= existing)


def prunable(rank: Column, pointer: Column, is_target: Column, aged: Column) -> Column:
    return F.coalesce(~is_target & aged & (rank < pointer), F.lit(False))


# Words of messages that mean that a log no longer holds a start revision.
EXPIRY_WORDS = ("start sequence", "first sequence", "sequence not found", "too old")


def is_expiry(message: Column) -> Column:
    """Does a message of a remote log say that the cursor has expired? For logs that tell it by text alone."""
    return names_any(message, EXPIRY_WORDS)


def names_any(message: Column, needles) -> Column:
    """Does a message contain one of the words, whatever the case?"""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(F.lower(message), F.lit(n.lower()))
    return out
