"""Per-document lifecycle over the audit log: a stream with state and timers, and a batch twin that splits documents.

A document is uploaded, decided, corrected and completed, and never moves back. Failures count as retries; the third
one fails it. After completion every event is late and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafscore.operators.slices import carried, sliced, within

MAX_RETRIES = 3
OUTPUT = (
    "document_id bigint, event_id bigint, action string, state string, retries int, corrections int, "
    "wait_ms double, late boolean"
)
STATE = "state string, retries int, corrections int, opened double, last bigint, timer bigint"
NEW = ("", 0, 0, -1.0)
#: Most events that one row of the state holds.
PACKED = 5_000

# Lifecycle position of each action; a document never moves back.
POSITION = {"document_uploaded": "uploaded", "decision_evaluated": "decided", "field_corrected": "corrected", "review_completed": "completed"}
RANK = {"": 0, "uploaded": 1, "decided": 2, "corrected": 3, "failed": 4, "completed": 5}


def advance(state: tuple, action: str, millis: float) -> tuple[tuple, float | None, bool]:
    """Next (state, retries, corrections, opened), the wait since the first event on completion, and lateness.

    Anything after completion is late and changes nothing. Failures count as retries up to the limit.
    """
    name, retries, corrections, opened = state
    if name == "completed":
        return state, None, True
    opened = millis if opened is None or opened < 0 else opened
    if action == "processing_failed":
        retries += 1
        name = "failed" if retries >= MAX_RETRIES else name
    else:
        corrections += action == "field_corrected"
        target = POSITION.get(action, name)
        name = target if RANK[target] >= RANK[name] else name
    wait = millis - opened if name == "completed" else None
    return (name, retries, corrections, opened), wait, False


def packed(micros: list[int], event_ids: list[int], actions: list[str]) -> list[tuple[list[int], list[int], list[str]]]:
    """Rows of the state for events given as lists."""
    return [tuple(c[at: at + PACKED] for c in (micros, event_ids, actions)) for at in range(0, len(micros), PACKED)]


class Lifecycle(StatefulProcessor):
    """Applies a document's events in event-time order, whatever the order they arrive in.

    Arrived events wait in a list state, packed: a row holds up to ``PACKED`` events as arrays, so state costs a call per
    pack and not per event. A repeated delivery counts once, by (time, event_id). One timer per
    document stands at its earliest waiting event; when the watermark has passed it, no earlier event can come any
    more, and all events up to the watermark are applied. With ``keep_ms`` a further timer forgets the document once
    the watermark is that far past its last event.
    """

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getListState("waiting", "micros array<bigint>, event_id array<bigint>, action array<string>")

    def _load(self) -> tuple[tuple, int | None, int | None]:
        row = self.state.get()
        if row is None:
            return NEW, None, None
        *current, last, timer = row
        return tuple(current), last, timer

    def _save(self, current: tuple, last: int | None, timer: int | None, wanted: int | None) -> None:
        """Store the document with its one timer at ``wanted``."""
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.state.update((*current, last, wanted))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        current, last, timer = self._load()
        earliest = None
        for part in rows:
            micros = part["created_at"].to_numpy("datetime64[us]").astype("int64").tolist()
            packs = packed(micros, part["event_id"].tolist(), part["action"].tolist())
            if packs:
                self.waiting.appendList(packs)
                earliest = min(micros) if earliest is None else min(earliest, *micros)
        # A document that waits to be forgotten has its timer later than any new event needs it.
        due = None if earliest is None else -(-earliest // 1000)
        self._save(current, last, timer, due if timer is None or due is None else min(due, timer))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        current, last, timer = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        # Of one event delivered twice, one is kept.
        events = {(when, event_id): action for pack in self.waiting.get() for when, event_id, action in zip(*pack, strict=True)}
        waiting = sorted(events)
        out = []
        for when, event_id in waiting:
            if when > now * 1000:
                break
            if last is not None and self._forgotten(last, when):
                current = NEW
            action = events[when, event_id]
            current, wait, late = advance(current, action, when / 1000)
            last = when
            out.append((key[0], event_id, action, current[0], current[1], current[2], wait, late))
        rest = waiting[len(out):]
        if out and rest:
            self.waiting.put(packed([w for w, _ in rest], [e for _, e in rest], [events[k] for k in rest]))
        elif out:
            self.waiting.clear()
        if rest:
            self._save(current, last, None, -(-rest[0][0] // 1000))
        elif self.keep_ms is None:
            self._save(current, last, None, None)
        elif last is not None and now >= last // 1000 + self.keep_ms:
            self.state.clear()
        else:
            self._save(current, last, None, last // 1000 + self.keep_ms)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def _forgotten(self, last: int, when: int) -> bool:
        return self.keep_ms is not None and when // 1000 >= last // 1000 + self.keep_ms

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, delay: str = "1 day", keep: timedelta | None = None) -> DataFrame:
    """Every event of a stream with the state it led to, in append mode; run it with the RocksDB state store.

    Events may arrive up to ``delay`` out of order; they are applied in time order (ties by event_id) and delivered
    once the watermark has passed them, so the result equals the batch twin's. Later ones are dropped, as by any
    watermark. A document whose next event comes ``keep`` or more after its last one starts anew, and its state goes
    once the watermark is that far, so state does not grow with all documents ever seen. Events without time or
    number are left out.
    """
    rows = events.select("document_id", "event_id", "action", "created_at").where("created_at IS NOT NULL AND event_id IS NOT NULL")
    processor = Lifecycle(None if keep is None else int(keep.total_seconds() * 1000))
    return rows.withWatermark("created_at", delay).groupBy("document_id").transformWithStateInPandas(
        processor, OUTPUT, "append", "EventTime")


def lifecycle_batch(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Batch twin of the stream (without ``keep``): states by slices of documents that are joined by a prefix.

    Events are range-partitioned by (document, time, event); a slice is what a partition has of a document, so a
    document with very many events is many slices and none is larger than a partition. Within a slice, running values
    are windows. A slice's effect on a document is a small summary: retries, corrections and highest position up to
    its first completion, its first time. Summaries compose, so the state in which a slice begins is what the summaries
    before it come to, of which a document has at most one per partition (``slices.carried``).
    """
    group, order = ["document_id"], ["created_at", "event_id"]
    cut = sliced(events.select(*group, *order, "action"), group, order, "lifecycle-slices", slices)
    own = within(group, order)
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    action = F.col("action")
    ranks = F.create_map(*[F.lit(x) for a, s in POSITION.items() for x in (a, RANK[s])])

    def count(cond: Column) -> Column:
        return F.count_if(~F.col("over") & cond).over(upto)

    local = cut.withColumn("over", F.coalesce(F.bool_or(action == "review_completed").over(before), F.lit(False))).withColumns({
        "n_retries": count(action == "processing_failed"),
        "n_corrections": count(action == "field_corrected"),
        "reached": F.coalesce(F.max(F.when(~F.col("over"), F.try_element_at(ranks, action))).over(upto), F.lit(0)),
    })
    # Retries, corrections and positions of the slices behind the document's first completion do not count.
    done = F.when(action == "review_completed", F.struct("created_at", "event_id"))
    parts = [F.min(done).alias("done"), F.max("n_retries").alias("r"), F.max("n_corrections").alias("c"), F.max("reached").alias("p"),
             F.min("created_at").alias("opened"), F.min(F.struct("created_at", "event_id")).alias("first")]
    live = F.col("end").isNull() | (F.col("first") <= F.col("end"))
    met = carried(local, group, parts, {
        "over_0": F.bool_or(F.col("done").isNotNull()), "opened_0": F.min("opened"), "n_retries_0": F.sum(F.when(live, F.col("r"))),
        "n_corrections_0": F.sum(F.when(live, F.col("c"))), "reached_0": F.max(F.when(live, F.col("p")))}, {"end": F.min("done")})
    met = met.withColumns({"over_0": F.coalesce("over_0", F.lit(False)), **{n: F.coalesce(n, F.lit(0)) for n in ("n_retries_0", "n_corrections_0", "reached_0")}})
    met = met.withColumns({
        "late": F.col("over_0") | F.col("over"),
        "retries": (F.col("n_retries_0") + F.when(F.col("over_0"), 0).otherwise(F.col("n_retries"))).cast("int"),
        "corrections": (F.col("n_corrections_0") + F.when(F.col("over_0"), 0).otherwise(F.col("n_corrections"))).cast("int"),
    })
    opened = F.least("opened_0", F.min("created_at").over(upto))
    reached = F.greatest(
        F.col("reached_0"), F.when(F.col("over_0"), 0).otherwise(F.col("reached")),
        F.when(F.col("retries") >= MAX_RETRIES, RANK["failed"]).otherwise(0))
    names = F.array(*[F.lit(n) for n, _ in sorted(RANK.items(), key=lambda p: p[1])])
    wait = (F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(opened.cast("timestamp"))) / 1000.0
    return met.select(
        "document_id", "event_id", "action", F.element_at(names, reached + 1).alias("state"), "retries", "corrections",
        F.when(~F.col("late") & (action == "review_completed"), wait).alias("wait_ms"), "late")
