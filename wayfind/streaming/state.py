"""Stateful operators over streams, a small state for each key in the state store: dedupe, transitions and authorisation.

Keys are dealt into buckets by their hash, and a bucket's states are one value of the store: a micro-batch calls Python once for each bucket that
it touches, not for each key. Rows of a key are taken in the order of their time or seq within a micro-batch. State that can change nothing any
more is dropped by an event-time timer. Times are carried as microseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of keys. A batch reads and writes the states of the buckets that it touches: more keys want more of them. A checkpoint holds for one number.
BUCKETS = 512


def start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a stream with the state store that these operators need; a session's own choice is put back."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(PROVIDER, before)


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch under its number; one that runs again replaces its own rows."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def _rows(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame | None:
    """A key's rows in order; None where there are none, as at the end of a stream's input."""
    held = [f for f in frames if len(f) and set(by) <= set(f.columns)]
    return pd.concat(held, ignore_index=True).sort_values(by, kind="stable") if held else None


def _forget_at(handle, times, at_us: int) -> None:
    """One timer for the key: any earlier one is dropped."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(max(at_us // 1000 + 1, times.getCurrentWatermarkInMs() + 1))


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class _Held:
    """The state of each key of a bucket, packed into one value of the store."""

    def __init__(self, handle, kind: pa.DataType) -> None:
        self.value, self.schema = handle.getValueState("held", "held binary"), pa.schema({"key": pa.string(), "state": kind})

    def read(self) -> dict:
        if not self.value.exists():
            return {}
        keys, states = pa.ipc.read_record_batch(pa.py_buffer(bytes(self.value.get()[0])), self.schema).columns
        return dict(zip(keys.to_pylist(), states.to_pylist()))

    def write(self, held: dict) -> None:
        if not held:
            self.value.clear()
            return
        columns = [pa.array(values, f.type) for values, f in zip((list(held), list(held.values())), self.schema)]
        self.value.update((bytearray(pa.RecordBatch.from_arrays(columns, schema=self.schema).serialize()),))


class _Dedupe(StatefulProcessor):
    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle) -> None:
        self.handle, self.last = handle, _Held(handle, pa.int64())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, ["at_us", "order_seq"])
        if batch is None:
            return
        held, kept = self.last.read(), []
        for own, at in zip(batch["dedupe_key"].tolist(), batch["at_us"].tolist()):
            last = held.get(own)
            kept.append(last is None or at - last >= self.window)
            if kept[-1]:
                held[own] = at
        # what the watermark has passed lets every row through that is still to come
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = {k: last for k, last in held.items() if last + self.window > passed}
        self.last.write(held)
        if held:
            _forget_at(self.handle, timerValues, max(held.values()) + self.window)
        yield batch[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.write({})
        return iter([])

    def close(self) -> None:
        pass


def dedupe(stream: DataFrame, seconds: int, key: Column, at: str = "arrived_at", seq: str = "seq", late: str = "1 hour") -> DataFrame:
    """Rows whose key's last kept row is at least so many seconds old, as dedupe_announcements gives them in batch.

    Unlike a drop within the watermark, a dropped row doesn't prolong the silence. Rows later than `late` are lost, as for any
    watermark. A null key is one key.
    """
    plain = [f for f in stream.columns if f != at]
    # times of the payload travel in microseconds as well, whatever the session's zone
    keyed = stream.withColumns({"dedupe_key": F.coalesce(key.cast("string"), F.lit("")), "at_us": F.unix_micros(F.col(at)), "order_seq": F.col(seq)}).withWatermark(at, late)
    times = [f.name for f in stream.schema.fields if isinstance(f.dataType, T.TimestampType) and f.name != at]
    keyed = keyed.withColumns({c: F.unix_micros(c) for c in times})
    schema = T.StructType([*[T.StructField(f.name, T.LongType() if f.name in times else f.dataType) for f in stream.schema.fields if f.name != at], T.StructField("at_us", T.LongType()), T.StructField("order_seq", stream.schema[seq].dataType)])
    out = keyed.select(_bucket(F.col("dedupe_key")).alias("__bucket"), "dedupe_key", *plain, at, "at_us", "order_seq").groupBy("__bucket").transformWithStateInPandas(_Columns(_Dedupe(seconds * 1_000_000), schema.names), schema, "Append", "EventTime")
    return out.select(*[(F.timestamp_micros("at_us") if c == at else F.timestamp_micros(c) if c in times else F.col(c)).alias(c) for c in stream.columns])


class _Columns(StatefulProcessor):
    """Another processor's rows with the columns of the output in order."""

    def __init__(self, inner: StatefulProcessor, names: list[str]) -> None:
        self.inner, self.names = inner, names

    def init(self, handle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in self.inner.handleInputRows(key, rows, timerValues):
            if len(frame):
                yield frame[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for frame in self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield frame[self.names]

    def close(self) -> None:
        self.inner.close()


class _Transitions(StatefulProcessor):
    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle) -> None:
        self.handle, self.last = handle, _Held(handle, pa.int64())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, ["at", "beat"])
        if batch is None:
            return
        held, found = self.last.read(), []
        for entity, at, beat in zip(batch["entity"].tolist(), batch["at"].tolist(), batch["beat"].tolist()):
            last = held.get(entity)
            if last is not None and at - last > self.silence:
                found.append((entity, "became_inactive", last + self.silence, None))
            if last is None or at - last > self.silence:
                found.append((entity, "became_active", at, beat))
            held[entity] = at if last is None else max(last, at)
        found += self._silent(held, timerValues, set(batch["entity"]))
        self.last.write(held)
        if held:
            _forget_at(self.handle, timerValues, min(held.values()) + self.silence)
        yield self._frame(found)

    def _silent(self, held: dict, times, but: set = frozenset()) -> list[tuple]:
        """Takes out the entities whose silence the watermark has passed, but for those of this batch."""
        passed = times.getCurrentWatermarkInMs()
        gone = [k for k, last in held.items() if (last + self.silence) // 1000 + 1 <= passed and k not in but]
        return [(k, "became_inactive", held.pop(k) + self.silence, None) for k in gone]

    @staticmethod
    def _frame(found: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(found, columns=["entity", "event", "at", "beat"])
        return frame.astype({"at": "int64", "beat": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.last.read()
        found = self._silent(held, timerValues)
        self.last.write(held)
        if held:
            _forget_at(self.handle, timerValues, min(held.values()) + self.silence)
        yield self._frame(found)

    def close(self) -> None:
        pass


def transitions(beats: DataFrame, entity: str, ts: str, beat: str, seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """(entity, event, at, beat): became_active at a first heartbeat, or the first after more than so many seconds of silence, with its number;
    became_inactive at the end of the silence that is allowed, once the watermark has passed it or a later heartbeat shows it."""
    rows = beats.select(F.col(entity).cast("string").alias("entity"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts)).alias("at"), F.col(beat).cast("long").alias("beat")).withWatermark("ts", late)
    out = rows.withColumn("__bucket", _bucket(F.col("entity"))).groupBy("__bucket").transformWithStateInPandas(_Columns(_Transitions(seconds * 1_000_000), ["entity", "event", "at", "beat"]), "entity string, event string, at long, beat long", "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


class _Authorize(StatefulProcessor):
    """Whether each announcement is accepted. The state is the key that owns each known entity."""

    def init(self, handle) -> None:
        self.owner = _Held(handle, pa.string())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, ["seq"])
        if batch is None:
            return
        held, changed, verdicts = self.owner.read(), False, []
        for entity, seq, action, own in zip(*(batch[c].tolist() for c in ("entity", "seq", "action", "own"))):
            known, pin = entity in held, held.get(entity)
            match = pin is None or pin == own
            accepted = action == "register" or action == "update" and (not known or match) or action in ("agent_status", "deregister") and known and match
            verdicts.append((seq, pin, bool(accepted)))
            if action in ("register", "update") and (not known or pin is None):
                held[entity], changed = own or None, True
        if changed:
            self.owner.write(held)
        frame = pd.DataFrame(verdicts, columns=["seq", "pin", "accepted"])
        frame["payload"] = batch["payload"].to_numpy()
        yield frame

    def close(self) -> None:
        pass


def authorize(stream: DataFrame, entity: str = "entity_id", key: str = "origin_public_key") -> DataFrame:
    """The stream's rows with pin and accepted, as replication.authorize gives them in batch; seq must rise from batch to batch."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    payload = F.to_json(F.struct(*stream.columns), exact)
    rows = stream.select(F.col(entity).cast("string").alias("entity"), "seq", "action", F.nullif(F.col(key), F.lit("")).alias("own"), payload.alias("payload"))
    out = rows.withColumn("__bucket", _bucket(F.col("entity"))).groupBy("__bucket").transformWithStateInPandas(_Columns(_Authorize(), ["pin", "accepted", "payload"]), "pin string, accepted boolean, payload string", "Append", "None")
    return out.select(F.from_json("payload", stream.schema, exact).alias("x"), "pin", "accepted").select("x.*", "pin", "accepted")
