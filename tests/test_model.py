"""Exhaustive exploration of small worlds that share the engine's kernels; every mutation has to be caught.

World 1: a log with retention, a watcher that resumes, a fold that must be a
fold of some prefix of the log, then converge. World 2: exporters that publish
and prune in any order.
"""

from collections import deque

import pytest

from ledgerfold import kernels as k

KEYS = "ab"


def explore(start, steps, holds):
    """First state that violates `holds`, or None."""
    seen, todo = {start}, deque([start])
    while todo:
        state = todo.popleft()
        if not holds(state):
            return state
        for new in steps(state):
            if new not in seen:
                seen.add(new)
                todo.append(new)
    return None


# State: (log: tuple of (key, put?) by revision, first, fold as tuple for KEYS, cursor, mode, frontier)
def watch_world(mutation=None, most=4, scoped=False):
    """scoped: watches of a prefix have no floor guard; there, retention is taken not to overrun a live watch."""

    def live(log):
        out = {}
        for key, put in log:
            out[key] = put
        return out

    def last_rev(log, key):
        return max((r for r, (x, _) in enumerate(log, 1) if x == key), default=0)

    def steps(s):
        log, first, fold, cursor, up = s
        if len(log) < most:
            for key in KEYS:
                for put in (True, False):
                    yield (*log, (key, put)), first, fold, cursor, up
        if first <= len(log) and not (scoped and up):
            yield log, first + 1, fold, cursor, up  # retention
        if not up:
            ok = mutation == "no_window_check" or k.resume_window_ok(cursor, first)
            if ok:
                yield log, first, fold, cursor, True
            else:  # expired: resync, then list
                now = dict(zip(KEYS, fold))
                if mutation != "no_resync":
                    for key in KEYS:
                        if not live(log).get(key) or last_rev(log, key) < first:
                            now[key] = 0
                for key in KEYS:
                    r = last_rev(log, key)
                    if r >= first and live(log).get(key):
                        now[key] = r
                    elif r >= first:
                        now[key] = 0
                yield log, first, tuple(now[x] for x in KEYS), len(log), True
        else:
            yield log, first, fold, cursor, False  # crash or stop
            nxt = max(cursor + 1, first)
            if nxt <= len(log):
                if not scoped and mutation != "no_floor_guard" and k.gap_is_loss(cursor, nxt, first):
                    yield log, first, fold, cursor, False  # the watch fails; a restart repairs
                else:
                    key, put = log[nxt - 1]
                    new = tuple((nxt if put else 0) if x == key else v for x, v in zip(KEYS, fold))
                    yield log, first, new, nxt, True
                    if mutation == "cursor_before_data":
                        yield log, first, fold, nxt, False

    def holds(s):
        log, first, fold, cursor, up = s
        if cursor != len(log):
            return True
        for key, v in zip(KEYS, fold):
            r = last_rev(log, key)
            put = live(log).get(key)
            if not put and v:
                return False  # a deleted key lives on
            if put and r >= first and v != r:
                return False  # a retained value is missing
        return True

    return ((), 1, (0,) * len(KEYS), 0, False), steps, holds


@pytest.mark.parametrize("scoped", [False, True])
def test_watch_converges(scoped):
    assert explore(*watch_world(scoped=scoped)) is None


@pytest.mark.parametrize("mutation, scoped", [("no_window_check", True), ("no_resync", False), ("no_resync", True), ("no_floor_guard", False), ("cursor_before_data", False)])
def test_watch_mutations_are_caught(mutation, scoped):
    assert explore(*watch_world(mutation, scoped=scoped)) is not None


# State: (pointer rank or None, payloads, per exporter (rank, stage), highest ever published)
def publish_world(mutation=None, ranks=(1, 2, 3)):
    def steps(s):
        pointer, payloads, exporters, top = s
        for i, (rank, stage) in enumerate(exporters):
            put = lambda e, i=i: exporters[:i] + (e,) + exporters[i + 1 :]
            if stage == 0:
                if mutation == "pointer_first":
                    yield rank, payloads, put((rank, 1)), max(top, rank)
                else:
                    yield pointer, payloads | {rank}, put((rank, 1)), top
            elif stage == 1:
                if mutation == "pointer_first":
                    yield pointer, payloads | {rank}, put((rank, 2)), top
                elif mutation == "no_rank_check" or k.publish_allowed(k.Pointer(pointer is not None, pointer), rank):
                    yield rank, payloads, put((rank, 2)), max(top, rank)
                else:
                    yield pointer, payloads, put((rank, 2)), top
        if pointer is not None:
            for p in payloads:
                gone = mutation == "prune_all" or k.payload_prunable(p, pointer, p == pointer and mutation != "no_target_check", True)
                if gone or (mutation == "prune_higher" and p != pointer):
                    yield pointer, payloads - {p}, exporters, top

    def holds(s):
        pointer, payloads, exporters, top = s
        waiting = {r for r, stage in exporters if stage == 1 and r >= (pointer or 0)}
        return pointer is None or (pointer in payloads and pointer >= top and (mutation == "pointer_first" or waiting <= payloads))

    return (None, frozenset(), tuple((r, 0) for r in ranks), 0), steps, holds


def test_pointer_never_regresses_and_its_target_exists():
    assert explore(*publish_world()) is None


@pytest.mark.parametrize("mutation", ["pointer_first", "no_rank_check", "prune_all", "prune_higher"])
def test_publish_mutations_are_caught(mutation):
    assert explore(*publish_world(mutation)) is not None
