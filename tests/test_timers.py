"""How often a key's state and timers are asked for, with a store that counts."""

import pytest

from lumenlake.streaming.states import IdleStates, JournalStates


class Store:
    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)


@pytest.mark.parametrize("own", [IdleStates(1000), JournalStates(1000)])
def test_a_batch_asks_the_store_twice_for_a_key(own):
    store = Store()
    own.init(store)
    for k in range(10):
        list(own.handleInputRows((1,), iter([{"at": k * 100_000, "seq": k, "state": "complete"}]), None))
    assert store.calls == 21 and store.timers == [1000]
