"""Structured Streaming forms of the operators: windows with watermarks and keyed state."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from visiontables.operators.ordered import lag_rows, rank_rows, running
from visiontables.operators.scan import scan_sorted
from visiontables.operators.stages import shared_folder
from visiontables.streaming.folds import RowStep
from visiontables.streaming.tracker import COLUMNS, SCHEMA, Settings, Tracker

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Rows of all sources from Parquet files as they arrive; what ``glob`` names in the folder may be a file or a folder of files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder.rstrip('/')}/{glob}")


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on a column that may be a timestamp without zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling_counts(df: DataFrame, ts: str, size: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding_counts(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def track_sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str]) -> DataFrame:
    """A track's stay ends when it is unseen for ``gap``."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def dedupe_events(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(list(keys))


def with_pauses(step: Callable[[dict, pd.DataFrame, bool], pd.DataFrame], pause_ms: int, time: str = "ts"):
    """``step`` that starts afresh where a key is unseen for more than ``pause_ms``, inside a batch as well as between batches.

    A step of rows gives a list of rows, another one a table.
    """

    def run(state: dict, pdf: pd.DataFrame, last: bool = False) -> pd.DataFrame | list[tuple]:
        at = pdf[time].to_numpy().astype("datetime64[ms]").astype("int64")
        new = np.flatnonzero(np.diff(at, prepend=state.get("_seen", at[0])) > pause_ms)
        if isinstance(step, RowStep):
            out = step.rows(state, pdf, set(new.tolist()))
            state["_seen"] = int(at[-1])
            return out
        edges = sorted({0, len(pdf), *new.tolist()})
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a in new:
                state.clear()
            out.append(step(state, pdf.iloc[a:b], last and b == len(pdf)))
        state["_seen"] = int(at[-1])
        return pd.concat(out, ignore_index=True)

    return run


#: Groups into which the keys of a stream are dealt; a group's states are read and written together. Part of a checkpoint.
GROUPS = 4096


def fold_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str], step, schema: str, ttl_ms: int | None = None,
                pause_ms: int | None = None, time: str = "ts", groups: int = GROUPS) -> DataFrame:
    """Keyed state over a stream; the key may include a video id, so that a new video starts afresh.

    Runs a state step over the rows of a key, batch after batch; rows of one batch are put in order first. State ends ``ttl_ms`` of
    processing time after its last change, or ``pause_ms`` of event time (column ``time``, which has a watermark) after its key was last
    seen; without either it stays. A call, with its table and its state, costs milliseconds and a key's few rows microseconds, so keys share
    calls: they are dealt by hash to ``groups``, whose states are those of their live keys.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    run = with_pauses(step, pause_ms, time) if pause_ms else step.rows if isinstance(step, RowStep) else step
    timeout = GroupStateTimeout.EventTimeTimeout if pause_ms else GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    by, key = list(order), list(keys)

    def advance(states: dict, batch: pd.DataFrame, now: int) -> pd.DataFrame:
        batch = batch.sort_values(by, kind="stable", ignore_index=True)
        number = batch.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
        batch, number = batch.take(np.argsort(number, kind="stable")), np.sort(number)
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(batch)]
        names = list(zip(*[batch[k].iloc[edges[:-1]].tolist() for k in key]))
        out = []
        for name, lo, hi in zip(names, edges[:-1], edges[1:], strict=True):
            own = states.setdefault(tuple(None if v != v else v for v in name), [0, {}])
            out.append(run(own[1], batch.iloc[lo:hi]))
            own[0] = now
        if isinstance(step, RowStep):
            return pd.DataFrame([row for rows in out for row in rows], columns=step.columns)
        return pd.concat(out, ignore_index=True)

    def fold(_key, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states = pickle.loads(held.get[0]) if held.exists else {}
        now = held.getCurrentProcessingTimeMs()
        out = advance(states, pd.concat(list(rows), ignore_index=True), now) if not held.hasTimedOut else ()
        if pause_ms:  # the watermark says that only a pause can follow
            passed = held.getCurrentWatermarkMs()
            states = {k: v for k, v in states.items() if v[1]["_seen"] + pause_ms >= passed}
        if ttl_ms:
            states = {k: v for k, v in states.items() if v[0] + ttl_ms > now}
        if states:
            held.update((pickle.dumps(states),))
            if pause_ms:
                held.setTimeoutTimestamp(max(min(v[1]["_seen"] for v in states.values()) + pause_ms, passed) + 1)
            elif ttl_ms:
                held.setTimeoutDuration(max(1, min(v[0] for v in states.values()) + ttl_ms - now))
        elif held.exists:
            held.remove()
        if len(out):
            yield out

    if isinstance(step, RowStep):
        df = df.select(*dict.fromkeys([*key, *by, *step.uses, *([time] if pause_ms else [])]))
    dealt = df.withColumn("_group", F.pmod(F.xxhash64(*key), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandasWithState(fold, schema, "blob binary", "append", timeout)


def fold_batch(df: DataFrame, key: str, order: Sequence[str], step, schema: str) -> DataFrame:
    return scan_sorted(df, key, list(order), dict, step, schema)


def track_stream(dets: DataFrame, settings: Settings = Settings(), keys: Sequence[str] = ("source_id",)) -> DataFrame:
    return fold_stream(dets, keys, ["frame", "det_id"], Tracker(settings).step, SCHEMA)


def track(dets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Track detections (source_id, frame, det_id, cls, conf, x1..y2, optional feat and warp) of finished videos.

    A pause longer than the track buffer leaves no track alive, so a source is cut at such pauses and its parts run
    in parallel; ids are then renumbered by what the earlier parts used. A video without a pause is one task: each
    frame needs the one before, but it streams through and only the live tracks are held.
    """
    tracker = Tracker(settings)
    frames = dets.select("source_id", "frame").distinct()
    coarse = F.floor(F.col("frame") / 4096)
    frames = rank_rows(frames, ["source_id"], [F.col("frame")], coarse, "_k")
    frames = lag_rows(frames, ["source_id"], "_k", {"frame": "_was"})
    cut = F.coalesce((F.col("frame") - F.col("_was") >= settings.buffer + 2).cast("int"), F.lit(0))
    frames = running(frames, ["source_id"], [F.col("frame")], coarse, {"_seg": ("sum", cut)}).select("source_id", "frame", "_seg")
    rows = dets.join(frames, ["source_id", "frame"]).withColumn("opens", F.col("_seg") == 0)
    rows = rows.withColumn("_part", F.concat_ws(":", "source_id", "_seg"))

    def step(state: dict, pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
        out = tracker.step(state, pdf, last)
        out["_seg"] = int(pdf["_seg"].iloc[0])
        if last:  # a closing row that carries the number of ids used
            end = {**dict.fromkeys(COLUMNS), "source_id": int(pdf["source_id"].iloc[0]), "track_id": state.get("next", 0), "_seg": int(pdf["_seg"].iloc[0])}
            out = pd.DataFrame([*out.to_dict("records"), end], columns=[*COLUMNS, "_seg"])
        return out.astype({c: "Int64" for c in ("source_id", "frame", "track_id", "det_id", "_seg")} | {"cls": "Int32"})

    from visiontables.operators.stages import materialize
    made = materialize(scan_sorted(rows, "_part", ["frame", "det_id"], dict, step, SCHEMA + ", _seg bigint", whole="frame"), "tracks")
    used = made.where("frame IS NULL").select("source_id", "_seg", F.col("track_id").alias("_used"))
    base = running(used, ["source_id"], [F.col("_seg")], F.floor(F.col("_seg") / 4096), {"_sum": ("sum", F.col("_used"))})
    base = base.select("source_id", "_seg", (F.col("_sum") - F.col("_used")).alias("_base"))
    placed = made.where("frame IS NOT NULL").join(base, ["source_id", "_seg"])
    return placed.withColumn("track_id", F.col("track_id") + F.col("_base")).select(*COLUMNS)


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read the result back; written to the shared folder, not collected."""
    spark = df.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out, check = f"{root}/out", f"{root}/check"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    else:
        def save(batch: DataFrame, _id: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        q = df.writeStream.foreachBatch(save).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_arrivals(arrivals: Sequence[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feed rows as they arrive: each table is added to a folder and ``stream`` of it resumes where it stopped, to what is there.

    A restart reads its place and its watermark from the checkpoint, so rows that are late by then are left out as they would be
    in a query that never stops.
    """
    spark, schema = arrivals[0].sparkSession, arrivals[0].schema
    root = f"{shared_folder(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{root}/in")
        df = stream(source_stream(spark, f"{root}/in", schema))
        df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def latest_only(batch: DataFrame, key: str = "source_id", order: str = "frame") -> DataFrame:
    """For foreachBatch: of each micro-batch keep every source's newest frame."""
    newest = batch.groupBy(key).agg(F.max(order).alias(order))
    return batch.join(newest, [key, order], "left_semi")


def score_stream(windows: DataFrame, refs: DataFrame, write: Callable[[DataFrame, int], None], technique: Column, default: float = 60.0):
    """Start a query that scores each full window (rows of ``rolling_sequences``) and hands the rows to ``write``."""
    from visiontables.operators import sequences as S

    def batch(rows: DataFrame, batch_id: int) -> None:
        write(score_windows(rows, refs, technique, default, S), batch_id)

    return windows.writeStream.foreachBatch(batch)


def run_scores(windows: DataFrame, refs: DataFrame, technique: Column, default: float = 60.0) -> DataFrame:
    """Score the full windows of a stream over what is there now and read the scores back.

    A batch is written under its number, so one that is repeated after a failure replaces itself. A stream without rows has no scores.
    """
    from visiontables.operators import sequences as S

    spark = windows.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"

    def write(scored: DataFrame, batch_id: int) -> None:
        scored.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    none = score_windows(spark.createDataFrame([], windows.schema), refs, technique, default, S)
    spark.createDataFrame([], none.schema).write.parquet(f"{root}/out/batch=-1")
    score_stream(windows, refs, write, technique, default).option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(none.schema).parquet(f"{root}/out")


def score_windows(rows: DataFrame, refs: DataFrame, technique: Column, default: float, S) -> DataFrame:
    keyed = rows.withColumn("seq_id", F.xxhash64("track_id", "at_frame"))
    users = S.assemble(keyed, ("seq_id",)).join(keyed.select("seq_id", "track_id", "at_frame", technique.alias("technique")).distinct(), "seq_id")
    best = S.best_reference(S.compare_to_references(users.drop("track_id", "at_frame"), refs))
    scored = S.score_rows(users.drop("track_id", "at_frame"), best, default=default)
    return scored.join(users.select("seq_id", "track_id", "at_frame"), "seq_id").drop("seq_id")
