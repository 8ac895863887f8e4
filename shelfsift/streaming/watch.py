"""Newly arriving files: admission, settling, notices.

All three are keyed streams on event time. What a key needs is kept in the state store and goes when
it is no longer needed; timers close what no later event closes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.paths import base_name, extension_of, path_key
from ..operators.categories import is_incomplete, media_kind
from ..operators.filters import Exclusion, extension_ignored, path_excluded
from ..operators.skew import first_by
from ..sources.layout import file_system

GIVE_UP_SECONDS = 30 * 60
#: How long the streams wait for events that come late.
LATENESS = "1 minute"
STABLE_REPEATS = 2
NOTICE_SECONDS = 20
#: Batches whose files are packed into one folder.
PACK_EVERY = 64
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admissible(events: DataFrame, exclusions: Sequence[Exclusion], ignored: Sequence[str]) -> DataFrame:
    """Events on media files that are not empty, excluded or ignored. Stateless, so it serves streams too."""
    named = events.withColumns({"file_name": base_name("full_path")}).withColumn("extension", extension_of("file_name"))
    named = named.withColumn("kind", media_kind())
    wanted = (F.col("kind") != "Unknown") | is_incomplete()
    return named.filter(wanted & (F.col("size_bytes") > 0) & ~path_excluded(exclusions) & ~extension_ignored(ignored))


def new_files(events: DataFrame, known: DataFrame, exclusions: Sequence[Exclusion], ignored: Sequence[str]) -> DataFrame:
    """Batch form: the first admissible event of each path the catalogue does not have, as a row awaiting its download."""
    keyed = admissible(events, exclusions, ignored).withColumn("path_key", path_key("full_path"))
    fresh = keyed.join(known.select(path_key("full_path").alias("path_key")), "path_key", "left_anti")
    first = first_by(fresh, ["path_key"], ["ts", "event_id"])
    return first.withColumns({"integrity": F.lit("Ok"), "awaiting_download": F.lit(True)})


ADMITTED = T.StructType([T.StructField("full_path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("at_us", T.LongType())])


def _state(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


class AdmissionProcessor(StatefulProcessor):
    """Lets the first event of a path through. The state holds one flag for each path seen so far,
    those of the catalogue included, so no batch looks anything up elsewhere."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _state(("seen", T.BooleanType())))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, first = self.seen.exists(), None
        for frame in rows:
            if not known and len(frame):
                row = frame.sort_values(["at_us", "event_id"]).iloc[0]
                if first is None or (row["at_us"], row["event_id"]) < (first["at_us"], first["event_id"]):
                    first = row
        if first is None:
            yield pd.DataFrame([], columns=ADMITTED.names)
            return
        self.seen.update((True,))
        yield pd.DataFrame([(first["full_path"], first["size_bytes"], first["at_us"])], columns=ADMITTED.names)

    def close(self) -> None:
        pass


def admitted_files(events: DataFrame, known: DataFrame, exclusions: Sequence[Exclusion] = (), ignored: Sequence[str] = ()) -> DataFrame:
    """Streaming: the first admissible event of each new path, as a row awaiting its download.

    ``known`` (full_path) is what the catalogue holds when the stream first starts; it is read once,
    into the state, and later batches read nothing but their own events.
    """
    keyed = _with_micros(admissible(events, exclusions, ignored)).select(path_key("full_path").alias("path_key"), "event_id", "at_us", "full_path", "size_bytes")
    held = known.select(path_key("full_path").alias("path_key")).distinct()
    first = keyed.groupBy("path_key").transformWithStateInPandas(
        statefulProcessor=AdmissionProcessor(), outputStructType=ADMITTED, outputMode="Append", timeMode="None", initialState=held.groupBy("path_key")
    )
    named = first.withColumn("file_name", base_name("full_path")).withColumn("extension", extension_of("file_name")).withColumn("kind", media_kind())
    return named.select(
        "full_path", "file_name", "extension", "kind", "size_bytes", F.timestamp_micros("at_us").alias("ts"),
        F.lit("Ok").alias("integrity"), F.lit(True).alias("awaiting_download"),
    )


def watch_new_files(
    events: DataFrame, known: DataFrame, target: str, checkpoint: str, exclusions: Sequence[Exclusion] = (), ignored: Sequence[str] = (),
    pack_every: int = PACK_EVERY,
):
    """Stream writer that stores new paths below ``target``, to be read by ``read_watched``.

    Each batch writes a folder of its own, so a batch that runs again after a failure replaces itself.
    Every so many batches their small files are packed into one folder; readers turn to it once it is
    whole, and the batches it holds are deleted when the pack after it is whole too.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batches/batch={batch_id}")
        if (batch_id + 1) % pack_every == 0:
            _pack(batch.sparkSession, target, batch_id + 1 - pack_every, batch_id)

    stream = admitted_files(events, known, exclusions, ignored)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def _listed(spark, folder: str) -> list[str]:
    fs, path = file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _whole_packs(spark, target: str) -> list[tuple[int, int, str]]:
    """(first batch, last batch, folder) of packs that were written to their end."""
    packs = []
    for name in _listed(spark, f"{target}/packs"):
        if "_SUCCESS" in _listed(spark, f"{target}/packs/{name}"):
            first, last = name.removeprefix("pack=").split("-")
            packs.append((int(first), int(last), f"{target}/packs/{name}"))
    return sorted(packs)


def _batches(spark, target: str) -> list[tuple[int, str]]:
    return sorted((int(name.removeprefix("batch=")), f"{target}/batches/{name}") for name in _listed(spark, f"{target}/batches") if name.startswith("batch="))


def _pack(spark, target: str, first: int, last: int) -> None:
    own = [folder for batch, folder in _batches(spark, target) if first <= batch <= last]
    rows = spark.read.parquet(*own)
    rows.repartition(max(1, rows.rdd.getNumPartitions() // PACK_EVERY), path_key("full_path")).write.mode("overwrite").parquet(f"{target}/packs/pack={first}-{last}")
    for batch, folder in _batches(spark, target):
        if batch < first:
            fs, path = file_system(spark, folder)
            fs.delete(path, True)


def read_watched(spark, target: str) -> DataFrame:
    """What ``watch_new_files`` has stored: whole packs, and the batches that are in none."""
    packs = _whole_packs(spark, target)
    loose = [folder for batch, folder in _batches(spark, target) if not any(a <= batch <= b for a, b, _ in packs)]
    schema = "full_path string, file_name string, extension string, kind string, size_bytes bigint, ts timestamp, integrity string, awaiting_download boolean"
    folders = [*[folder for _, _, folder in packs], *loose]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


SETTLED = T.StructType([
    T.StructField("full_path", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("at_us", T.LongType()),
])


def _timer_ms(us: int) -> int:
    """The first whole millisecond that is not before ``us``."""
    return -(-us // 1000)


class SettledProcessor(StatefulProcessor):
    """A watch opens with a path's first poll. It is settled when the size repeats twice in a row and is
    not 0, and given up 30 minutes after it opened: by a poll past that time or, without one, by its
    timer. Either way the state is cleared, and a later poll opens a new watch.
    """

    span = GIVE_UP_SECONDS * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watch = handle.getValueState("watch", _state(("first_us", T.LongType()), ("size", T.LongType()), ("repeats", T.IntegerType())))
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = state = self.watch.get() if self.watch.exists() else None
        polls = pd.concat([frame[["at_us", "event_id", "size_bytes"]] for frame in rows]).sort_values(["at_us", "event_id"])
        out = []
        for at, size in zip(polls["at_us"].tolist(), polls["size_bytes"].tolist()):
            if state is not None and at >= state[0] + self.span:
                out.append((key[0], "given up", None, state[0] + self.span))
                state = None
            if state is None:
                state = (at, size, 0)
                continue
            state = (state[0], size, state[2] + 1 if size == state[1] and size > 0 else 0)
            if state[2] >= STABLE_REPEATS:
                out.append((key[0], "settled", size, at))
                state = None
        if before is not None and (state is None or state[0] != before[0]):
            self.handle.deleteTimer(_timer_ms(before[0] + self.span))
        if state is None:
            self.watch.clear()
        else:
            self.watch.update(state)
            if before is None or state[0] != before[0]:
                self.handle.registerTimer(_timer_ms(state[0] + self.span))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.watch.get() if self.watch.exists() else None
        if state is None or _timer_ms(state[0] + self.span) > expiredTimerInfo.getExpiryTimeInMs():
            yield self._frame([])
            return
        self.watch.clear()
        yield self._frame([(key[0], "given up", None, state[0] + self.span)])

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=SETTLED.names).astype({"size_bytes": "Int64", "at_us": "int64"})

    def close(self) -> None:
        pass


NOTICES = T.StructType([
    T.StructField("watcher", T.StringType()),
    T.StructField("opened_us", T.LongType()),
    T.StructField("files", T.LongType()),
    T.StructField("first_name", T.StringType()),
])


class NoticeProcessor(StatefulProcessor):
    """One summary per burst: the first file opens a window that later ones do not extend."""

    def __init__(self, seconds: int = NOTICE_SECONDS) -> None:
        self.span = notice_span(seconds) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.burst = handle.getValueState("burst", _state(("opened_us", T.LongType()), ("files", T.LongType()), ("first_name", T.StringType())))
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = state = self.burst.get() if self.burst.exists() else None
        arrivals = pd.concat([frame[["at_us", "event_id", "file_name"]] for frame in rows]).sort_values(["at_us", "event_id"])
        out = []
        for at, name in zip(arrivals["at_us"].tolist(), arrivals["file_name"].tolist()):
            if state is not None and at >= state[0] + self.span:
                out.append((key[0], *state))
                state = None
            state = (at, 1, name) if state is None else (state[0], state[1] + 1, state[2])
        if before is not None and before[0] != state[0]:
            self.handle.deleteTimer(_timer_ms(before[0] + self.span))
        if before is None or before[0] != state[0]:
            self.handle.registerTimer(_timer_ms(state[0] + self.span))
        self.burst.update(state)
        yield pd.DataFrame(out, columns=NOTICES.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.burst.get() if self.burst.exists() else None
        if state is None or _timer_ms(state[0] + self.span) > expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([], columns=NOTICES.names)
            return
        self.burst.clear()
        yield pd.DataFrame([(key[0], *state)], columns=NOTICES.names)

    def close(self) -> None:
        pass


def notice_span(seconds: int) -> int:
    return min(max(seconds, 1), 600)


def _with_micros(events: DataFrame) -> DataFrame:
    return events.withColumn("at_us", F.unix_micros("ts"))


def settled_files(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming: (full_path, outcome, size_bytes, at_us) from polls (event_id, ts, full_path, size_bytes).

    Polls may come ``lateness`` after later ones; a path that is polled no more is given up once the
    stream's time is 30 minutes and ``lateness`` past its first poll. One key's polls of one batch are
    put in order in memory; ``maxFilesPerTrigger`` bounds them.
    """
    polls = _with_micros(events.withWatermark("ts", lateness)).select("event_id", "ts", "at_us", "full_path", "size_bytes")
    return polls.groupBy("full_path").transformWithStateInPandas(
        statefulProcessor=SettledProcessor(), outputStructType=SETTLED, outputMode="Append", timeMode="EventTime"
    )


def new_file_notices(events: DataFrame, seconds: int = NOTICE_SECONDS, lateness: str | None = None) -> DataFrame:
    """Streaming: (watcher, opened_us, files, first_name), one notice per burst and watcher, from arrivals
    (event_id, ts, watcher, file_name). Arrivals may come ``lateness`` after later ones, by default as
    long as a burst lasts. The burst that is open when a stream stops is in ``open_bursts``."""
    arrivals = _with_micros(events.withWatermark("ts", lateness or f"{notice_span(seconds)} seconds")).select("event_id", "ts", "at_us", "watcher", "file_name")
    return arrivals.groupBy("watcher").transformWithStateInPandas(
        statefulProcessor=NoticeProcessor(seconds), outputStructType=NOTICES, outputMode="Append", timeMode="EventTime"
    )


def open_bursts(spark, checkpoint: str) -> DataFrame:
    """The bursts a stopped notice stream has still open, read from its state: the flush when watching ends."""
    state = spark.read.format("statestore").option("stateVarName", "burst").load(checkpoint)
    return state.select(F.col("key.watcher").alias("watcher"), F.col("value.opened_us").alias("opened_us"), F.col("value.files").alias("files"), F.col("value.first_name").alias("first_name"))


def notice_text(files: Column | str = "files", first_name: Column | str = "first_name") -> Column:
    """The notice as a user sees it."""
    count, name = (F.col(c) if isinstance(c, str) else c for c in (files, first_name))
    return F.when(count == 1, F.concat(F.lit("Added new file: "), name)).otherwise(
        F.concat(F.lit("Added "), count.cast("string"), F.lit(" new files, starting with "), name, F.lit("."))
    )


def run_to_table(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, append it to a Parquet folder and read that back."""
    use_state_store(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(target)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def use_state_store(spark) -> None:
    """Keyed state with timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
