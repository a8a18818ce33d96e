"""A job's rows that come together set one timer, and go to its state at once."""

import pandas as pd

from spindrift.streaming.tracker import JobTracker


class Handle:
    """Counts what the processor asks of its state."""

    def __init__(self):
        self.timers, self.calls, self.held = [], 0, []

    def _state(self, *_):
        return self

    getListState = getMapState = getValueState = _state

    def registerTimer(self, at):
        self.timers.append(at)

    def appendList(self, rows):
        self.calls += 1
        self.held += rows

    def updateValue(self, *row):
        self.calls += 1


def test_calls_do_not_grow_with_the_rows_of_a_job():
    tracker, handle = JobTracker(1, 10), Handle()
    tracker.init(handle)
    n = 500
    rows = pd.DataFrame({"ts_us": [k * 5_000 + 1 for k in range(n, 0, -1)], "seq": range(n), "status": "running", "progress": range(n)})
    assert list(tracker.handleInputRows((1,), iter([rows]), None)) == []
    assert handle.timers == [6] and handle.calls == 1 and len(handle.held) == n
