"""A book's state is read and written once for each call, however many of its events wait."""

from types import SimpleNamespace

from pyspark.sql import Row

from spanloom.streaming.state import Playback


class Store:
    """A handle whose only variable counts how often it is asked."""

    def __init__(self):
        self.held, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def registerTimer(self, at):
        self.timers.append(at)


def test_one_read_and_one_write(spark):
    store, p = Store(), Playback()
    p.init(store)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    came = [Row(us=1000 * t, event_id=t, op="begin", chunk=t) for t in (5, 3, 4, 9)]
    out = [*p.handleInputRows((7,), iter(came), at(5))]
    assert [(r.event_id, r.status, r.playing) for r in out] == [(3, "PLAYING", 3), (4, "PLAYING", 4)]
    assert (store.calls, store.timers) == (2, [6]) and len(store.held[4]) == 2
    out = [*p.handleExpiredTimer((7,), at(10), None)]
    assert [(r.event_id, r.book_id, r.us) for r in out] == [(5, 7, 5000), (9, 7, 9000)] and store.calls == 4 and not store.held[4]
