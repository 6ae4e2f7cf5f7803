import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafscore.streaming import kpis as K
from leafscore.streaming import lifecycle as L
from leafscore.streaming.run import Arrivals, run_available

SCHEMA = "event_id bigint, document_id bigint, action string, field_name string, created_at timestamp"
ACTIONS = ["document_uploaded", "decision_evaluated", "field_corrected", "review_completed", "processing_failed"]


def rows(n=400):
    start = datetime(2024, 1, 1)
    return [(i, (i * 7) % 23, ACTIONS[(i * 5 + i // 9) % 5], "total" if i % 3 else None, start + timedelta(minutes=37 * i)) for i in range(n)]


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """Day files in time order, with a fixed set of rows arriving one file late."""
    folder = str(tmp_path_factory.mktemp("audit"))
    days: dict[int, list] = {}
    for r in rows():
        days.setdefault((r[4] - datetime(2024, 1, 1)).days + (1 if r[0] % 13 == 0 else 0), []).append(r)
    for day in sorted(days):
        spark.createDataFrame(days[day], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def batch(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.mark.parametrize("build, end", [(K.daily_kpis, "window_end"), (K.correction_rate, "window_end"), (K.review_sessions, "session_end")])
def test_closed_windows_equal_the_batch(stream, batch, build, end):
    got = {tuple(r) for r in run_available(build(stream(), "2 days"), "t").collect()}
    want = {tuple(r) for r in build(batch).collect()}
    # Late rows advance no watermark, so only windows far from the end are certain to be closed.
    sure = batch.agg(F.max("created_at")).first()[0] - timedelta(days=3)
    names = build(batch).columns
    closed = {w for w in want if w[names.index(end)] <= sure}
    assert closed <= got <= want and len(closed) > 0


def test_repeated_delivery_counts_once(stream, batch):
    twice = stream().unionByName(stream())
    got = run_available(K.dedup(twice, "2 days"), "t").select("event_id").collect()
    assert sorted(r[0] for r in got) == list(range(400))
    assert K.dedup(batch.unionByName(batch)).count() == 400


def replay(spark, folder, events, build, keys=None, **options):
    """The stream over files that arrive late and out of order, stopped after three of them and resumed."""
    feed = Arrivals(events, f"{folder}/in", "created_at", F.col("event_id") % 13 == 0, parts=6)

    def run():
        files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed.folder)
        return run_available(build(files, feed.delay), "t", location=f"{folder}/sink", **options)

    for part in range(3):
        feed.send(part)
    first = run().count()
    for part in range(3, feed.parts + 1):
        feed.send(part)
    feed.close(event_id=F.lit(-1), document_id=F.lit(-1), action=F.lit("field_corrected"))
    return first, run()


def test_lifecycle_equals_the_batch_however_events_arrive(spark, batch, tmp_path):
    """Late and out-of-order arrivals in seven files, several micro-batches, one restart: every event as in the batch."""
    shuffled = batch.orderBy(F.hash("event_id")).coalesce(1)
    first, rows_ = replay(spark, str(tmp_path), shuffled, L.lifecycle, rocksdb=True)
    got = sorted((tuple(r) for r in rows_.collect()), key=lambda r: r[1])
    want = sorted((tuple(r) for r in L.lifecycle_batch(batch).collect()), key=lambda r: r[1])
    assert got == want and 0 < first < len(got) == 400
    commits = list((tmp_path / "sink" / "checkpoint" / "commits").glob("[0-9]*"))
    assert len(commits) >= 8


@pytest.mark.parametrize("build", [K.daily_kpis, K.correction_rate, K.review_sessions])
def test_a_closed_stream_delivers_every_window_by_itself(spark, batch, tmp_path, build):
    first, rows_ = replay(spark, str(tmp_path), batch, build)
    want = sorted(map(str, build(batch).collect()))
    assert sorted(map(str, rows_.collect())) == want and 0 < first < len(want)


def test_repeated_deliveries_and_ties_apply_once_in_order(spark, tmp_path):
    when = datetime(2024, 1, 1)
    part = [(2, 5, "review_completed", None, when), (1, 5, "field_corrected", None, when), (3, 5, "field_corrected", None, when)]
    events = spark.createDataFrame(part + part, SCHEMA)
    _, rows_ = replay(spark, str(tmp_path), events, L.lifecycle, rocksdb=True)
    got = sorted((r.event_id, r.state, r.corrections, r.late) for r in rows_.collect())
    assert got == [(1, "corrected", 1, False), (2, "completed", 1, False), (3, "completed", 1, True)]


def plain_lifecycle(events):
    out, states = {}, {}
    for e in sorted(events, key=lambda r: (r[1], r[4], r[0])):
        state, wait, late = L.advance(states.get(e[1], L.NEW), e[2], e[4].timestamp() * 1000)
        states[e[1]] = state
        out[e[0]] = (e[1], e[2], *state[:3], wait, late)
    return out


@pytest.mark.parametrize("slices", [None, 1, 13])
def test_batch_lifecycle_matches_the_plain_loop_for_a_hot_document(spark, slices):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    early = ACTIONS[:3] + ["processing_failed", "note"]
    events = [(i, rng.choice([1, 1, 1, 2, 3, 4, 50]), rng.choice(early if i < 2300 else ACTIONS), None, start + timedelta(seconds=rng.randint(0, 9999) + 20 * i))
              for i in range(3000)]
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    got = {r.event_id: (r.document_id, r.action, r.state, r.retries, r.corrections, r.wait_ms, r.late) for r in L.lifecycle_batch(df, slices).collect()}
    want = plain_lifecycle(events)
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k][:5] == w[:5] and got[k][6] == w[6] and got[k][5] == pytest.approx(w[5])


def test_a_hot_document_is_several_slices(spark):
    from leafscore.operators.slices import SLICE, sliced

    df = spark.range(4000).select(F.lit(1).alias("document_id"), F.col("id").alias("event_id"))
    sizes = [r[1] for r in sliced(df, ["document_id"], ["event_id"], "t", 8).groupBy(SLICE).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1500


def test_lifecycle_steps():
    state = ("", 0, 0, -1.0)
    seen = []
    for k, action in enumerate(["document_uploaded", "processing_failed", "processing_failed", "processing_failed", "field_corrected", "review_completed", "field_corrected"]):
        state, wait, late = L.advance(state, action, float(k))
        seen.append((state[0], state[1], wait, late))
    assert [s[0] for s in seen] == ["uploaded", "uploaded", "uploaded", "failed", "failed", "completed", "completed"]
    assert seen[3][1] == 3 and seen[5][2] == 5.0 and seen[6][3]


class Named:
    """A session on a cluster, as far as the folder choice can see."""

    class sparkContext:
        master = "spark://host"

    def __init__(self, folder):
        self.folder = folder

    @property
    def conf(self):
        return self

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_shared_folder_comes_from_the_session(tmp_path):
    from leafscore.session import shared_dir

    assert shared_dir(Named("/shared"), "x").startswith("/shared/x-")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Named(None), "x")


def test_a_stopped_stream_resumes_without_repeats_or_gaps(spark, tmp_path):
    """The same location goes on after the first run; a new one starts afresh."""
    folder, location = str(tmp_path / "audit"), str(tmp_path / "sink")

    def add(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run(**where):
        rows_ = K.dedup(spark.readStream.schema(SCHEMA).parquet(folder), "60 days")
        return sorted(r.event_id for r in run_available(rows_, "t", **where).collect())

    add(rows()[:150])
    assert run(location=location) == list(range(150))
    add(rows()[100:300])
    assert run(location=location) == list(range(300))
    assert run(location=location) == list(range(300))
    assert run() == list(range(300))


def test_lifecycle_state_expires(spark, tmp_path):
    """Day files: document 1 returns long after its last event and starts anew; document 2 stays in time."""
    start = datetime(2024, 1, 1)
    days = [
        [(1, 1, "review_completed", None, start), (2, 2, "field_corrected", None, start)],
        [(3, 2, "field_corrected", None, start + timedelta(days=2))],
        [(4, 3, "document_uploaded", None, start + timedelta(days=30)), (5, 2, "field_corrected", None, start + timedelta(days=30))],
        [(6, 3, "decision_evaluated", None, start + timedelta(days=31))],
        [(7, 1, "field_corrected", None, start + timedelta(days=60)), (8, 3, "field_corrected", None, start + timedelta(days=32))],
        [(9, 9, "field_corrected", None, start + timedelta(days=200))],
    ]
    folder = str(tmp_path / "events")
    for part in days:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)

    def run(keep):
        rows_ = run_available(L.lifecycle(files, "2 days", keep), "t", rocksdb=True)
        return {r.event_id: (r.state, r.corrections, r.late) for r in rows_.collect()}

    got = run(timedelta(days=10))
    assert got[3] == ("corrected", 2, False) and got[8] == ("corrected", 1, False)
    assert got[5] == ("corrected", 1, False) and got[7] == ("corrected", 1, False)  # their earlier states are gone
    kept = run(None)
    assert kept[7] == ("completed", 0, True) and kept[5] == ("corrected", 3, False)


def test_micro_batches_do_not_grow_with_the_files_of_a_part(spark, tmp_path):
    """A table of many splits arrives in one file a part, so the state is gone through a few times only."""
    events = spark.createDataFrame(rows(), SCHEMA).repartition(16)
    feed = Arrivals(events, str(tmp_path / "in"), "created_at", F.col("event_id") % 13 == 0)
    for part in range(feed.parts + 1):
        feed.send(part)
    assert feed.files == 1 and len(list((tmp_path / "in").glob("*.parquet"))) == feed.parts + 1
    assert spark.read.parquet(feed.folder).count() == 400


def test_arrived_events_cost_a_state_call_per_pack():
    """Calls for state must not grow with a document's events: 12,000 of them, delivered twice, are a few rows."""
    import pandas as pd

    calls = []

    class State:
        held = None

        def __getattr__(self, name):
            def call(*values):
                calls.append(name)
                if name == "get":
                    return self.held if isinstance(self, Value) else iter(self.held or [])
                if name == "exists":
                    return self.held is not None
                self.held = {"appendList": lambda: [*(self.held or []), *values[0]], "put": lambda: values[0],
                             "update": lambda: values[0], "clear": lambda: None}[name]()
            return call

    class Value(State):
        pass

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getListState(self, *_):
            return State()

        def registerTimer(self, _):
            calls.append("timer")

        deleteTimer = registerTimer

    class Times:
        def getCurrentWatermarkInMs(self):
            return 9_000_000

    n = 12_000
    part = pd.DataFrame({"created_at": pd.to_datetime(range(n), unit="s"), "event_id": range(n), "action": ["field_corrected"] * n})
    machine = L.Lifecycle(None)
    machine.init(Handle())
    machine.handleInputRows((7,), iter([part, part]), Times())
    out = next(machine.handleExpiredTimer((7,), Times(), None))
    assert len(calls) < 20
    assert out["event_id"].tolist() == list(range(9_001)) and out["corrections"].iloc[-1] == 9_001
