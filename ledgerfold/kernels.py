"""Pure decisions that the engine, its tests and the model checker share."""

from __future__ import annotations

from dataclasses import dataclass

U64_MAX = (1 << 64) - 1
MAX_VERSION_BYTES = 10


def resume_window_ok(cursor: int, first_sequence: int) -> bool:
    """Does the log still hold every change after the cursor? Saturates at the top."""
    return first_sequence <= min(cursor + 1, U64_MAX)


def resume_start(cursor: int) -> int:
    """First revision to deliver after the cursor; never wraps."""
    if cursor >= U64_MAX:
        raise OverflowError("no revision follows the last one")
    return cursor + 1


def gap_is_loss(frontier: int, revision: int, first_sequence: int) -> bool:
    """Did delivery jump over revisions that retention removed unseen?"""
    return revision > frontier + 1 and not resume_window_ok(frontier, first_sequence)


@dataclass(frozen=True)
class Pointer:
    """What a publish pointer holds: nothing, an unreadable record (rank None), or a rank."""

    present: bool = False
    rank: int | None = None


def publish_allowed(pointer: Pointer, candidate: int) -> bool:
    """A pointer never goes back; an unreadable one may be replaced."""
    return not pointer.present or pointer.rank is None or candidate >= pointer.rank


def payload_prunable(rank: int | None, pointer_rank: int, is_target: bool, aged: bool) -> bool:
    """Only old payloads of known, lower rank that the pointer doesn't name."""
    return not is_target and aged and rank is not None and rank < pointer_rank


def token(revision: int | None) -> bytes:
    """Version bytes of a revision: empty if unknown, else 8 bytes big-endian."""
    return b"" if revision is None else revision.to_bytes(8, "big")


def token_revision(raw: bytes) -> int | None:
    """The revision of a token, if it is one; other tokens stay opaque."""
    check_token(raw)
    return int.from_bytes(raw, "big") if len(raw) == 8 else None


def check_token(raw: bytes) -> bytes:
    if len(raw) > MAX_VERSION_BYTES:
        raise ValueError(f"a version has at most {MAX_VERSION_BYTES} bytes, not {len(raw)}")
    return raw


def cursor_hex(cursor: int | None) -> str:
    return token(cursor).hex()


def parse_cursor_hex(text: str) -> int | None:
    """Inverse of cursor_hex. Odd length or other letters raise ValueError."""
    if text != text.lower():
        raise ValueError("cursor digits are lower case")
    return token_revision(bytes.fromhex(text))


def rank_of(cursor: int | None) -> int:
    return cursor or 0


def payload_name(cursor: int | None, digest_hex: str) -> str:
    return f"{rank_of(cursor):016x}-{digest_hex[:16]}"


def payload_rank(name: str) -> int | None:
    head, dash, _ = name.partition("-")
    try:
        return int(head, 16) if dash and len(head) == 16 else None
    except ValueError:
        return None
