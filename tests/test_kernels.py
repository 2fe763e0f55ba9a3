import pytest

from ledgerfold import kernels as k


def test_resume_window():
    assert k.resume_window_ok(3, 4) and k.resume_window_ok(3, 1) and not k.resume_window_ok(3, 5)
    assert k.resume_window_ok(k.U64_MAX, k.U64_MAX)
    assert k.resume_start(3) == 4
    with pytest.raises(OverflowError):
        k.resume_start(k.U64_MAX)


def test_gap():
    assert k.gap_is_loss(1, 4, 4) and not k.gap_is_loss(1, 4, 2) and not k.gap_is_loss(3, 4, 4)


def test_publish_and_prune():
    five = k.Pointer(True, 5)
    assert k.publish_allowed(k.Pointer(), 0) and k.publish_allowed(k.Pointer(True), 0)
    assert [k.publish_allowed(five, c) for c in (4, 5, 6)] == [False, True, True]
    assert k.payload_prunable(4, 5, False, True)
    assert not any(k.payload_prunable(r, 5, t, a) for r, t, a in [(5, False, True), (6, False, True), (4, True, True), (None, False, True), (4, False, False)])


def test_tokens():
    assert k.token(None) == b"" and k.token_revision(k.token(42)) == 42 and k.token_revision(b"1234567890") is None
    assert k.cursor_hex(42) == "000000000000002a" and k.parse_cursor_hex("") is None and k.parse_cursor_hex(k.cursor_hex(7)) == 7
    for bad in ("abc", "zz", "AB" * 8, "00" * 11):
        with pytest.raises(ValueError):
            k.parse_cursor_hex(bad)
    name = k.payload_name(9, "ab" * 32)
    assert k.payload_rank(name) == 9 and k.payload_rank("junk") is None and k.payload_rank("zzzzzzzzzzzzzzzz-ab") is None
