"""Live captions, session memory and job progress as keyed streams, with their batch twins.

A stream's key is one live session, whose state is small and expires. Fragments wait in the state until the watermark has
passed their event time, and are then taken in ``seq`` order, so triggers and the order of arrival make no difference:
event times of a session must not fall as ``seq`` rises. Rows behind the watermark are dropped and counted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lectern.functions import text as T
from lectern.operators.dialogue import MAX_TURNS
from lectern.operators.ordered import Running, running
from lectern.session import scratch_path

CHUNK_ROWS = 9600
IDLE_MS = 30 * 60 * 1000
#: A session that has been silent this long may come back under its numbers from 0.
FORGET_MS = 30 * 24 * 3600 * 1000
LATENESS = "10 minutes"
SEQ_SHARD = 100_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _expiring(df: DataFrame, delay: str) -> tuple[DataFrame, str]:
    """A stream with an event time gets a watermark, and its silent sessions expire; a stream
    without one keeps its sessions, as nothing tells how old they are."""
    if "ts" in df.columns:
        return df.withWatermark("ts", delay), GroupStateTimeout.EventTimeTimeout
    return df, GroupStateTimeout.NoTimeout


def _renew(state: GroupState, rows: pd.DataFrame, idle_ms: int) -> None:
    if "ts" in rows:
        latest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)


# --------------------------------------------------------------------------- event order


class Fold:
    """What a session's fragments make, one after another; ``state`` is JSON."""

    columns: list[str]
    first: dict

    def step(self, key: object, state: dict, seq: int, text: str | None, final: bool) -> list[tuple]:
        raise NotImplementedError

    def rest(self, key: object, state: dict) -> list[tuple]:
        """Rows for what is unfinished when the session falls silent; the state then holds nothing but its numbers."""
        raise NotImplementedError


class InOrder(StatefulProcessor):
    """Feeds a session's fragments to a ``Fold`` in order.

    Held rows are released by an event-time timer at the earliest of them. A gap longer than ``idle_ms`` ends what is
    unfinished, whether a later fragment or only the watermark shows it, and the numbers go on after it.
    """

    def __init__(self, fold: Fold, idle_ms: int, forget_ms: int) -> None:
        self.fold, self.idle_ms, self.forget_ms = fold, idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at bigint, seq bigint, text string, is_final boolean")
        self.done = handle.getValueState("done", "state string, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            # Rounded up to ms: the watermark has whole ms, and rows up to it can come no more.
            at = -(-batch["ts"].astype("datetime64[us]").astype("int64") // 1000)
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            finals = [bool(f) if f is not None else False for f in batch["is_final"]]
            self.held.appendList(list(zip(at.tolist(), batch["seq"].astype("int64").tolist(), texts, finals, strict=True)))
            earliest = min(earliest or at.min(), at.min())
        if earliest is not None:
            self.handle.registerTimer(int(earliest))
        # A frame costs as much as a session's few rows, so none is sent without rows.
        yield from self._frames([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.held.get())
        ready = sorted((r for r in held if r[0] <= now), key=lambda r: r[1])
        waiting = [r for r in held if r[0] > now]
        packed, last = self.done.get() if self.done.exists() else (json.dumps(self.fold.first), None)
        state, out = json.loads(packed), []
        for at, seq, text, final in ready:
            if last is not None and at - last > self.idle_ms:
                out += self.fold.rest(key[0], state)
            out += self.fold.step(key[0], state, seq, text, final)
            last = at if last is None else max(last, at)
        if ready:
            self.held.put(waiting) if waiting else self.held.clear()
            self.handle.registerTimer(int(last + self.idle_ms))
        if last is not None and now >= last + self.idle_ms:
            out += self.fold.rest(key[0], state)
            self.handle.registerTimer(int(last + self.forget_ms))
        if last is not None and now >= last + self.forget_ms and not waiting:
            self.done.clear()
        elif last is not None:
            self.done.update((json.dumps(state), int(last)))
        if waiting:
            self.handle.registerTimer(int(min(r[0] for r in waiting)))
        yield from self._frames(out)

    def _frames(self, rows: list[tuple]) -> list[pd.DataFrame]:
        return [pd.DataFrame(rows, columns=self.fold.columns)] if rows else []

    def close(self) -> None:
        pass


def _in_event_order(fragments: DataFrame, fold: Fold, schema: str, idle_ms: int, forget_ms: int) -> DataFrame:
    # The operator keeps lists and timers, which only this store has.
    fragments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    slim = fragments.select("session_id", "seq", "ts", "text", "is_final").withWatermark("ts", LATENESS)
    return slim.groupBy("session_id").transformWithStateInPandas(InOrder(fold, idle_ms, forget_ms), schema, "append", "eventtime")


def _parts(fragments: DataFrame, idle_ms: int | None) -> DataFrame:
    """Fragments with the number of their part, which an end marker or a gap ends, and their rank in the session."""
    shard = F.floor(F.col("seq") / SEQ_SHARD).cast("bigint")
    rows = fragments
    gap = F.lit(0)
    if idle_ms is not None:
        at = F.ceil(F.unix_micros("ts") / 1000)
        rows = running(rows.withColumn("_at", at), ["session_id"], ["seq"], shard, [Running("_before", "lag", F.col("_at"))])
        gap = F.coalesce((F.col("_at") - F.col("_before") > idle_ms).cast("int"), F.lit(0))
    ended = F.coalesce("is_final", F.lit(False)).cast("int")
    ids = running(
        rows.withColumn("_gap", gap).withColumn("_final", ended), ["session_id"], ["seq"], shard,
        [
            Running("_ended", "sum", F.col("_final")),
            Running("_gaps", "sum", F.col("_gap")),
            Running("_i", "sum", F.lit(1).cast("bigint")),
        ],
    )
    return ids.withColumn("_part", F.col("_ended") - F.col("_final") + F.col("_gaps"))


# --------------------------------------------------------------------------- fixed-size chunks


class Chunks(Fold):
    columns = ["session_id", "chunk_no", "n", "text", "last_seq"]
    first = {"texts": [], "no": 0, "seq": None}

    def __init__(self, n: int) -> None:
        self.n = n

    def step(self, key, state, seq, text, final):
        state["texts"].append(text or "")
        state["seq"] = seq
        return self.rest(key, state) if final or len(state["texts"]) == self.n else []

    def rest(self, key, state):
        if not state["texts"]:
            return []
        row = (key, state["no"], len(state["texts"]), "".join(state["texts"]), state["seq"])
        state["texts"], state["no"] = [], state["no"] + 1
        return [row]


def rechunk_stream(fragments: DataFrame, n: int = CHUNK_ROWS, idle_ms: int = IDLE_MS, forget_ms: int = FORGET_MS) -> DataFrame:
    """Per session: a chunk for every ``n`` fragments; an end marker or a silence flushes the rest.

    The state holds the fragments that the watermark has not passed, fewer than ``n`` texts and the chunk number.
    """
    key_type = dict(fragments.dtypes)["session_id"]
    schema = f"session_id {key_type}, chunk_no bigint, n bigint, text string, last_seq bigint"
    return _in_event_order(fragments, Chunks(n), schema, idle_ms, forget_ms)


def rechunk_batch(fragments: DataFrame, n: int = CHUNK_ROWS, idle_ms: int | None = None) -> DataFrame:
    """Batch twin of ``rechunk_stream``. With ``idle_ms`` as of a stream whose sessions have all fallen silent; without, no
    gap ends a chunk and the unflushed rest of a session stays out."""
    ids = _parts(fragments, idle_ms)
    # Position inside the part: rank less that of its first fragment.
    first = ids.groupBy("session_id", "_part").agg(F.min("_i").alias("_base"))
    placed = ids.join(first, ["session_id", "_part"]).withColumn("_slot", F.floor((F.col("_i") - F.col("_base")) / n))
    chunks = placed.groupBy("session_id", "_part", "_slot").agg(
        F.count("*").alias("n"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), ""
        ).alias("text"),
        F.max("seq").alias("last_seq"),
        F.max("_final").alias("_final"),
    )
    full = chunks if idle_ms is not None else chunks.filter((F.col("n") == n) | (F.col("_final") == 1))
    numbered = running(
        full, ["session_id"], ["last_seq"], F.floor(F.col("last_seq") / SEQ_SHARD).cast("bigint"),
        [Running("_no", "sum", F.lit(1).cast("bigint"))],
    )
    return numbered.select("session_id", (F.col("_no") - 1).alias("chunk_no"), "n", "text", "last_seq")


# --------------------------------------------------------------------------- captions


class Captions(Fold):
    columns = ["session_id", "utt_no", "seq", "kind", "text"]
    first = {"said": "", "no": 0, "seq": None}

    def step(self, key, state, seq, text, final):
        state["seq"] = seq
        out = []
        if text and text.strip():
            state["said"] += text
            out.append((key, state["no"], seq, "partial", text))
        return out + self._close(key, state) if final else out

    def rest(self, key, state):
        return self._close(key, state) if state["said"] else []

    def _close(self, key, state):
        row = (key, state["no"], state["seq"], "final", state["said"])
        state["said"], state["no"] = "", state["no"] + 1
        return [row]


def accumulate_captions(fragments: DataFrame, idle_ms: int = IDLE_MS, forget_ms: int = FORGET_MS) -> DataFrame:
    """Emit a ``partial`` row per visible fragment and a ``final`` row with the whole utterance
    at each end marker, and for what a session leaves unfinished when it falls silent."""
    key_type = dict(fragments.dtypes)["session_id"]
    schema = f"session_id {key_type}, utt_no bigint, seq bigint, kind string, text string"
    return _in_event_order(fragments, Captions(), schema, idle_ms, forget_ms)


def caption_finals(fragments: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Batch twin: the final text of every utterance closed by an end marker or, with ``idle_ms``, by a silence, the last
    one of each session being followed by one."""
    spoken = F.when(~T.is_blank("text"), F.struct("seq", "text"))
    # An utterance is what one person says up to an end marker.
    said = _parts(fragments, idle_ms).groupBy("session_id", "_part").agg(
        F.max("_final").alias("_closed"), F.max("seq").alias("seq"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(spoken)), lambda x: x["text"]), ""
        ).alias("text"),
    )
    closed = said.filter((F.col("_closed") == 1) | (F.lit(idle_ms is not None) & (F.col("text") != "")))
    numbered = running(
        closed, ["session_id"], ["seq"], F.floor(F.col("seq") / SEQ_SHARD).cast("bigint"),
        [Running("_no", "sum", F.lit(1).cast("bigint"))],
    )
    return numbered.select("session_id", (F.col("_no") - 1).alias("utt_no"), "seq", "text")


# --------------------------------------------------------------------------- memory and progress


def session_memory(turns: DataFrame, max_turns: int = MAX_TURNS, idle_ms: int = IDLE_MS) -> DataFrame:
    """The trimmed history of a session after each trigger, as JSON; idle sessions expire.

    The last turns by number stay, so the order of arrival makes no difference.
    """
    keep = 2 * max_turns

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        history = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames))
        for turn, role, content in rows[["turn", "role", "content"]].itertuples(index=False):
            if content:
                history.append({"turn": int(turn), "role": role, "content": content})
        history = sorted(history, key=lambda turn: turn["turn"])[-keep:]
        packed = json.dumps(history, ensure_ascii=False)
        state.update((packed,))
        _renew(state, rows, idle_ms)
        yield pd.DataFrame([(key[0], len(history), packed)], columns=["session_id", "messages", "history"])

    key_type = dict(turns.dtypes)["session_id"]
    timed, timeout = _expiring(turns, LATENESS)
    return timed.groupBy("session_id").applyInPandasWithState(
        step, f"session_id {key_type}, messages bigint, history string", "history string",
        "update", timeout,
    )


def job_progress(items: DataFrame) -> DataFrame:
    """Done, failed and latest item per task; works on streams (update mode) and tables."""
    return items.groupBy("task_id").agg(
        F.count("*").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.max("seq").alias("latest"),
        F.max_by("file", "seq").alias("current"),
    )


def amend_lines(versions: DataFrame) -> DataFrame:
    """The latest text of every caption line: a finalised line may be replaced later."""
    return versions.groupBy("session_id", "line_no").agg(
        F.max_by("text", "version").alias("text"), F.max("version").alias("version")
    )


def within_watermark(fragments: DataFrame, delay: str = LATENESS) -> DataFrame:
    """Drop repeated deliveries of a fragment, with state bounded by the watermark."""
    return fragments.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "seq"])


# --------------------------------------------------------------------------- sinks


def stream_partials(captions: DataFrame) -> DataFrame:
    return captions.filter("kind = 'partial'")


def stream_finals(captions: DataFrame) -> DataFrame:
    return captions.filter("kind = 'final'")


def close_at(fragments: DataFrame, ts: object) -> DataFrame:
    """The stream and one fragment at ``ts`` that is never released itself: it takes the watermark past all before it.

    For sources read in one trigger; a source of many triggers gets such a row in its last file.
    """
    spark, path = fragments.sparkSession, scratch_path(fragments.sparkSession, "closing")
    row = spark.range(1).select(
        F.lit("0").cast(dict(fragments.dtypes)["session_id"]).alias("session_id"), F.lit(0).cast("bigint").alias("seq"),
        F.lit(ts).cast("timestamp").alias("ts"), F.lit("").alias("text"), F.lit(False).alias("is_final"),
    )
    row.write.parquet(path)
    return fragments.select(*row.columns).unionByName(spark.readStream.schema(row.schema).parquet(path))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished query has dropped because they came behind the watermark."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)


def run_available(
    stream: DataFrame, spark: SparkSession, label: str, mode: str = "append", ended: Callable[[StreamingQuery], None] | None = None
) -> DataFrame:
    """Process what the source holds now and return what was emitted, with its ``batch``; ``ended`` gets the query.

    Each micro-batch overwrites its own folder, so a repeated batch after a failure leaves no
    duplicates.
    """
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, label + "-state")

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    query.awaitTermination()
    if ended:
        ended(query)
    return spark.read.schema(StructType(stream.schema.fields).add("batch", "long")).parquet(out)
