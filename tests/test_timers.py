"""A key knows its one timer: neither timers nor waiting blocks are listed to set it."""

import pandas as pd

from verdigris.streaming import stateful


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    lists = 0
    updateValue, getValue, containsKey, removeKey = dict.__setitem__, dict.__getitem__, dict.__contains__, dict.__delitem__

    def keys(self):
        self.lists += 1
        return list(super().keys())


class Handle:
    def __init__(self):
        self.timers = set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()


class Watermark:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_one_timer_per_key():
    machine, handle = stateful.ReviewMachine(), Handle()
    machine.waits = machine.timed = True
    machine.init(handle)
    put = lambda *minutes: list(machine.handleInputRows((1,), iter([pd.DataFrame([(60_000_000 * at, at, "planning") for at in minutes], columns=["at", "sequence", "to_status"])]), None))

    def fire(at):
        """As Spark does: a timer goes once it has been handled."""
        rows = [tuple(row) for frame in machine.handleExpiredTimer((1,), Watermark(at), Watermark(at)) for row in frame[["sequence", "late"]].itertuples(index=False)]
        handle.timers.discard(at)
        return rows

    assert put(7, 9, 300) == [] and handle.timers == {8 * 60_000}
    assert put(5, 8) == [] and handle.timers == {6 * 60_000}
    assert put(20) == [] and handle.timers == {6 * 60_000} and not machine.blocks.lists
    assert fire(6 * 60_000) == [(5, False)] and handle.timers == {8 * 60_000}
    assert machine.blocks.lists == 1
    late = put(2, 30)
    assert [tuple(row) for row in late[0][["sequence", "late"]].itertuples(index=False)] == [(2, True)] and handle.timers == {8 * 60_000}
    assert [sequence for sequence, _ in fire(8 * 60_000)] == [7] and handle.timers == {9 * 60_000}
    assert [sequence for sequence, _ in fire(9 * 60_000)] == [8] and handle.timers == {10 * 60_000}
    assert [sequence for at in (10, 21, 31, 301) for sequence, _ in fire(at * 60_000)] == [9, 20, 30, 300]
    assert not handle.timers and machine.timer.get() is None and not machine.blocks
