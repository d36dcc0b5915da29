"""Incremental counterparts on Structured Streaming.

A stream over a table's files is run to its end (``availableNow``) into a folder below the
cluster's checkpoint folder, with its state in RocksDB.  Rows of a key are taken in order of (ts, event_id)
whatever batch brings them: a key's state holds those that the clock hasn't passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstream.operators.rows import status_rank
from quillstream.session import shared_folder

STRIKES = 3
#: Later than any row, and within pandas' nanoseconds: with it, a replay moves the watermark past all of them.
END = "2261-01-01 00:00:00"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    found = spark.read.format("binaryFile").load(f"{sf_dir}/{table}.parquet").select("path").where(F.col("path").contains(f"{table}.parquet/")).head(1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(f"{sf_dir}/{table}.parquet") if found else stream.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def replay(source: DataFrame, operator: Callable[[DataFrame], DataFrame], progress: list | None = None) -> DataFrame:
    """All that is in ``source`` now, through the operator and to its end, as a table.

    The stream runs to the end of its files.  Then one row of time ``END`` and nulls comes on a second
    source, and the same query goes on from its checkpoint: what was held or open is given out.
    ``progress`` gets the micro-batches' reports.
    """
    spark, folder = source.sparkSession, shared_folder(source.sparkSession)
    spark.createDataFrame([], source.schema).write.parquet(f"{folder}/end")
    out = operator(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{folder}/end")))

    def run() -> None:
        provider = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(provider)
        spark.conf.set(provider, STORE)
        try:
            query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        finally:
            spark.conf.set(provider, before)
        query.awaitTermination()
        if progress is not None:
            progress.extend(query.recentProgress)

    run()
    last = [F.lit(END if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in source.schema]
    spark.range(1).select(last).write.mode("append").parquet(f"{folder}/end")
    run()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """STRM-1: a work queue in micro-batches."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/state").trigger(availableNow=True).start()
    query.awaitTermination()


class InOrder(StatefulProcessor):
    """``step(rows, carried)`` on each user's rows in order of time and id, as far as the clock has come.

    The clock is ``late`` behind the latest row of the batches before.  State, typed and in the state store: what
    is carried on from row to row (a value), and the rows that the clock hasn't passed (a list); a timer goes off when
    it passes the first of them.  A row that the clock had passed when it came is given out at once, marked as late.
    The watermark is ``late`` behind the clock: rows that it had passed a batch ago never get here, Spark counts them.
    """

    def __init__(self, step: Callable, kind: str, carried: str, late_ms: int):
        self.step, self.kind, self.carried_kind, self.late_ms = step, kind, carried, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", f"value {self.carried_kind}")
        self.held = handle.getListState("held", f"us bigint, event_id bigint, value {self.kind}")

    def _clock_us(self, times) -> int:
        watermark = times.getCurrentWatermarkInMs()
        return 1000 * (watermark + self.late_ms) if watermark > 0 else -1 << 62  # no batch before

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = self._clock_us(timerValues)
        new = [(r.us, r.event_id, r.value) for r in rows]
        for us, event_id, value in new:
            if us <= clock:
                yield Row(user_id=key[0], event_id=event_id, value=value, late=True)
        new = [r for r in new if r[0] > clock]
        if new:
            self.held.appendList(new)
            self._wait(min(r[0] for r in new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        clock = self._clock_us(timerValues)
        held = sorted(self.held.get(), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        passed = [r for r in held if r[0] <= clock]
        if not passed:
            return
        before = self.carried.get()[0] if self.carried.exists() else None
        found, after = self.step(passed, before)
        self.carried.update((after,))
        rest = held[len(passed) :]
        if rest:
            self.held.put(rest)
            self._wait(rest[0][0])
        else:
            self.held.clear()
        for event_id, value in found:
            yield Row(user_id=key[0], event_id=event_id, value=value, late=False)

    def _wait(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1 - self.late_ms)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, value: Column, kind: str, carried: str, late: str, step: Callable) -> DataFrame:
    """(user_id, event_id, value, late) of what ``step`` puts out, and of the late rows; see ``InOrder``.

    ``step`` takes a user's rows (microseconds, event_id, value) in order and what was carried on, null at first; it gives
    (event_id, value) of each row to put out, and what to carry on.
    """
    late_ms = stream.sparkSession.sql(f"select unix_millis(timestamp_seconds(0) + interval {late})").head()[0]
    timed = stream.select("user_id", "event_id", value.cast(kind).alias("value"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", f"{2 * late_ms} milliseconds")
    timed = timed.where("at is not null").withColumn("us", F.unix_micros("at"))
    return timed.groupBy("user_id").transformWithState(InOrder(step, kind, carried, late_ms), f"user_id long, event_id long, value {kind}, late boolean", "append", "eventtime")


def changes(stream: DataFrame, late: str) -> DataFrame:
    """STRM-2: events whose type differs from the user's last one (A, B, A gives three)."""

    def step(rows: list[tuple], last: str | None) -> tuple[list[tuple], str | None]:
        found = []
        for _, event_id, kind in rows:
            if kind != last:
                found.append((event_id, kind))
            last = kind
        return found, last

    return in_order(stream, F.col("event_type"), "string", "string", late, step).withColumnRenamed("value", "event_type")


def advances(stream: DataFrame, ranks: tuple[str, ...], late: str) -> DataFrame:
    """STRM-3: events that outrank all of the user's earlier ones."""

    def step(rows: list[tuple], best: int | None) -> tuple[list[tuple], int]:
        best, found = best or 0, []
        for _, event_id, rank in rows:
            if rank > best:
                found.append((event_id, rank))
                best = rank
        return found, best

    return in_order(stream, status_rank(F.col("event_type"), ranks), "int", "int", late, step).withColumnRenamed("value", "rank")


def strikes(stream: DataFrame, failed: str, late: str, most: int = STRIKES) -> DataFrame:
    """STRM-5: for each user the event with which ``most`` failures in a row were reached, once until a success."""

    def step(rows: list[tuple], count: int | None) -> tuple[list[tuple], int]:
        count, found = count or 0, []
        for _, event_id, bad in rows:
            count = count + 1 if bad else 0
            if count == most:
                found.append((event_id, bad))
        return found, count

    return in_order(stream, F.coalesce(F.expr(failed), F.lit(False)), "boolean", "int", late, step).drop("value")


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """STRM-4, STRM-8: counts by hour and type; a window closes once the watermark has passed it."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
