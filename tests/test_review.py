"""Review: state read and written once a batch, replay of many cells a call."""

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from somatica.operators import qa
from somatica.streaming import review

AREAS = (200, 300, 400)


class Store:
    """State variables in memory that count how often they are called."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def getValueState(self, name, schema):  # noqa: N802
        return One(self, name)

    def getMapState(self, name, *schemas):  # noqa: N802
        return One(self, name)


class One:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _call(self, f, *args):
        self.store.calls += 1
        return f(*args)

    def get(self):
        return self._call(self.store.kept.get, self.name)

    def update(self, value):
        self._call(self.store.kept.__setitem__, self.name, value)

    def getValue(self, key):  # noqa: N802
        return self._call(self.store.kept.get, (self.name, key))

    def updateValue(self, key, value):  # noqa: N802
        self._call(self.store.kept.__setitem__, (self.name, key), value)

    def removeKey(self, key):  # noqa: N802
        self._call(self.store.kept.pop, (self.name, key))


def drawn(n: int, seed: int, undo: float) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(s, int(rng.choice((*AREAS, 900))), "undo" if rng.random() < undo else str(rng.choice(("approve", "reject")))) for s in range(n)]


def test_state_is_called_by_batch_not_by_event():
    """Stacks that grow over several blocks and shrink again, in batches of any size, against the plain fold."""
    events = drawn(400, 1, 0.2) + [(400 + s, a, o) for s, a, o in drawn(500, 2, 0.8)] + [(900 + s, a, o) for s, a, o in drawn(100, 3, 0.3)]
    want, _ = qa.fold(list(AREAS), events)
    for size in (1, 7, 250, 1000):
        store, last = Store(), dict.fromkeys(AREAS)
        r = review.Review(AREAS)
        r.init(store)
        for i in range(0, len(events), size):
            before = store.calls
            rows = iter([Row(seq=s, cell=5, area=a, op=o) for s, a, o in events[i : i + size][::-1]])
            for row in r.handleInputRows((5,), rows, None):
                assert row.cell == 5
                last[row.area] = row.approved
            assert store.calls - before <= 4 + 2 * (size // review.BLOCK + 1)
        assert last == want


def test_replay_of_many_cells_a_call(spark):
    events = [(s, c, a, o) for c in range(40) for s, a, o in drawn(60, c, 0.3)]
    masks = spark.createDataFrame([(c, a) for c in range(41) for a in AREAS], "cell long, area int")
    found = qa.replay_with_undo(masks, spark.createDataFrame(events, "seq long, cell long, area int, op string").orderBy(F.rand(3)))
    assert "FlatMapCoGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(c, a): v for c in range(41) for a, v in qa.fold(list(AREAS), [(s, a, o) for s, k, a, o in events if k == c])[0].items()}
    assert {(r.cell, r.area): r.approved for r in found.collect()} == want
