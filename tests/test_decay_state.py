"""Decayed counters take one read and one write per user and batch."""

import pandas as pd

from clickloom.streaming import stateful


class _Value:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_decayed_counters_take_one_read_and_one_write_a_user():
    calls = []

    class Handle:
        def getValueState(self, name, schema):
            return _Value(calls)

    counts = stateful.DecayedCounts(("click", "buy"), half_life_days=1.0)
    counts.init(Handle())
    day = 86_400_000
    rows = lambda *r: pd.DataFrame(r, columns=["entity", "ts", "arrival", "pos", "kind"])
    first = rows(("b", day, 1, 0, "click"), ("b", 0, 0, 0, "click"), (None, 5, 2, 0, "buy"))
    [one] = counts.handleInputRows(("u",), iter([first]), None)
    assert {tuple(r) for r in one.itertuples(index=False)} == {("u", "b", 1.5, 0.0, day), ("u", "None", 0.0, 1.0, 5)}
    later = [rows(("b", 3 * day, 4, 0, "buy")), rows(("b", 2 * day, 3, 0, "click"), ("c", 7, 5, 0, "click"))]
    [two] = counts.handleInputRows(("u",), iter(later), None)
    assert {tuple(r) for r in two.itertuples(index=False)} == {("u", "b", 1.75, 1.0, 3 * day), ("u", "c", 1.0, 0.0, 7)}
    assert calls == ["get", "update"] * 2
