"""Pages of all entities as a stream, in any order."""

import pandas as pd
from pyspark.sql import functions as F

from gridlake.plans.ingest import RaceStore
from gridlake.sources.landing import landed_pages
from gridlake.streaming.ingest import settle, stream_landing, wait_for_parent

FACTS = ("race_results", "driver_standings")
ENTITIES = ("seasons", "circuits", "constructors", "drivers", "races", *FACTS)


def land(event, root, *names):
    for name in names:
        landed_pages(event, name).select("payload").write.mode("append").text(f"{root}/{name}")


class State:
    """What ``wait_for_parent`` uses of a group's state."""

    def __init__(self):
        self.value, self.timeout, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.timeout = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def frame(*rows):
    return pd.DataFrame(rows, columns=["entity", "record", "status"])


def left(state, *frames):
    return [tuple(r) for f in wait_for_parent(("k", 0), iter(frames), state, 50) for r in f.values.tolist()]


def test_state_of_one_parent():
    state = State()
    assert left(state, frame(("e", "1", "late"), ("e", "p", "new")), frame(("e", "1", "late"), ("e", "2", "late"))) == [("e", "p", "new")]
    assert len(state.value[0]) == 2 and state.timeout == 50
    assert left(state, frame(("e", "1", "late"))) == [] and len(state.value[0]) == 2
    assert left(state, frame(("p", None, "stored"), ("e", "3", "late"))) == [("e", "1", "new"), ("e", "2", "new"), ("e", "3", "new")]
    assert not state.exists and left(state, frame(("p", None, "stored"))) == [] and not state.exists
    left(state, frame(("e", "4", "late")))
    state.hasTimedOut = True
    assert left(state) == [("e", "4", "expired")] and not state.exists


def test_facts_wait_for_their_parents(spark, event, tmp_path):
    landing, store = str(tmp_path / "landing"), RaceStore(spark, str(tmp_path / "store"))

    def run(**how):
        stream_landing(spark, landing, store, salts=2, entities=ENTITIES, **how).awaitTermination()

    def stored():
        return {n: store.read(n).count() for n in FACTS}

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        land(event, landing, *FACTS)
        run()
        assert stored() == dict.fromkeys(FACTS, 0) and store.read("rejects").count() == 0
        land(event, landing, "drivers", "constructors", "races")
        run()  # races wait for seasons and circuits
        assert store.read("races").count() == 0 and stored() == dict.fromkeys(FACTS, 0)
        assert store.read("drivers").count() == 6 and store.read("rejects").count() == 0
        land(event, landing, "seasons", "circuits")
        assert settle(spark, landing, store, salts=2, entities=ENTITIES) >= 3
        assert stored() == {n: event[n].count() for n in FACTS} and store.read("rejects").count() == 0
        found = store.read("race_results").where("driver_id = 'bea'").first()
        assert (found.time_millis, str(found.points)) == (4011350, "20.00")
        # A parent that never comes: the row waits, then goes to the rejects; a replay of that batch adds none.
        ghost = type(event).of({"race_results": event.race_results.withColumn("driver_id", F.concat(F.lit("x"), "driver_id"))})
        land(ghost, landing, "race_results")
        run(hold_seconds=0)
        run(hold_seconds=0)  # held now
        land(event, landing, "seasons")
        run(hold_seconds=0)
        assert [r.reason for r in store.read("rejects").collect()] == ["parent not found"] * 6
        last = max((tmp_path / "store" / "_streams").glob("*/all/commits/[0-9]*"), key=lambda p: int(p.name))
        for name in (last, last.with_name(f".{last.name}.crc")):
            name.unlink(missing_ok=True)
        run(hold_seconds=0)
        assert store.read("rejects").count() == 6
        assert stored() == {n: event[n].count() for n in FACTS}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
