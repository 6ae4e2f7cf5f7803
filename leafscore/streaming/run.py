"""Run a streaming query over everything available and read its sink back; feed files to one in parts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscore.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(
    stream: DataFrame, label: str, output_mode: str = "append", location: str | None = None, rocksdb: bool = False,
) -> DataFrame:
    """Write a stream to a parquet sink with its checkpoint in a shared folder, until no input is left.

    The file sink commits each micro-batch once. A job that is to be resumed names a stable ``location``: a later
    call with it goes on where the last one stopped and neither repeats nor drops rows. Without one, every call
    starts afresh in a folder of its own. Operators with map state and timers need ``rocksdb``, which also keeps large
    state off the heap.
    """
    spark = stream.sparkSession
    base = location or shared_dir(spark, label)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    if rocksdb:
        spark.conf.set(setting, ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode(output_mode)
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{base}/rows")
        )
        query.awaitTermination()
    finally:
        if rocksdb and before is not None:
            spark.conf.set(setting, before)
        elif rocksdb:
            spark.conf.unset(setting)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


class Arrivals:
    """A table of events as files that arrive one after the other, some rows late, and a closing row at the end.

    The time span is cut into ``parts``; rows that ``late`` picks arrive one part later than their time, so a watermark
    of ``delay`` loses none. The closing row comes last; it is so far behind the last event (``beyond`` seconds past
    the delay) that the watermark passes every window that an event of the table can be in.

    A part is at most ``files`` files, one per ``ROWS`` of its rows. A stream that takes as many files per trigger makes
    about one micro-batch of a part, whatever the table's size and splits; where parts have fewer files, a batch runs on into
    the next part, which loses nothing: its watermark stays a part behind what is still to come.
    """

    ROWS = 250_000

    def __init__(self, events: DataFrame, folder: str, time: str, late: Column, parts: int = 6, beyond: int = 8 * 86_400) -> None:
        self.events, self.folder, self.time, self.parts = events, folder, time, parts
        low, high, n = events.agg(F.min(time), F.max(time), F.count(F.lit(1))).first()
        self.low = low or datetime(2000, 1, 1)
        self.span = int((high - low).total_seconds()) + 1 if low else 1
        self.width = -(-self.span // parts)
        self.late, self.beyond = late, beyond
        self.files = max(1, -(-n // (parts * self.ROWS)))

    @property
    def delay(self) -> str:
        return f"{2 * self.width + 60} seconds"

    def send(self, part: int) -> None:
        """Let the rows of one part arrive; they may be none."""
        seconds = F.col(self.time).cast("timestamp").cast("long") - F.lit(self.low).cast("timestamp").cast("long")
        arrives = F.floor(seconds / self.width) + F.when(self.late, 1).otherwise(0)
        self.events.where(arrives == part).coalesce(self.files).write.mode("append").parquet(self.folder)

    def close(self, **values: Column) -> None:
        """Let the closing row arrive: null but for its time and the given values."""
        schema = self.events.schema
        when = F.lit(self.low).cast(schema[self.time].dataType) + F.make_dt_interval(secs=F.lit(self.span + 2 * self.width + 60 + self.beyond))
        row = self.events.sparkSession.range(1).select(*[
            (when if f.name == self.time else values.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema])
        row.write.mode("append").parquet(self.folder)
