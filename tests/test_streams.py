import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from visiontables.plans import fixtures as fx
from visiontables.streaming import folds
from visiontables.streaming import streams as ST
from visiontables.streaming.tracker import Settings, Tracker, gating_distance, start_track

T0 = dt.datetime(2024, 1, 1)
DET = "source_id bigint, frame bigint, det_id bigint, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


def files(spark, rows, schema, folder, per):
    """Write rows as several files that a stream reads one by one, oldest first."""
    import os
    for i in range(0, len(rows), per):
        spark.createDataFrame(rows[i:i + per], schema).coalesce(1).write.parquet(f"{folder}/part{i:05d}")
        for f in os.listdir(f"{folder}/part{i:05d}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{folder}/in", exist_ok=True)
                os.rename(f"{folder}/part{i:05d}/{f}", f"{folder}/in/{i:05d}.parquet")
                os.utime(f"{folder}/in/{i:05d}.parquet", (1700000000 + i, 1700000000 + i))
    return f"{folder}/in"


def walkers(frames, sources=(0,), gap=None):
    """Two boxes per source that walk to the right; a pause after frame ``gap`` if given."""
    out, n = [], 0
    for s in sources:
        for f in frames:
            for k in (0, 1):
                t = f + (1000 if gap is not None and f > gap else 0)
                out.append((s, t, n, k, 0.9 - 0.5 * (f % 7 == 3), 10.0 + 3 * f, 50.0 + 200 * k, 60.0 + 3 * f, 130.0 + 200 * k))
                n += 1
    return out


def test_tracker_follows_two_walkers(spark):
    d = spark.createDataFrame(walkers(range(1, 40), (0, 1)), DET)
    t = ST.track(d)
    assert {(r.source_id, r.track_id) for r in t.collect()} == {(s, i) for s in (0, 1) for i in (1, 2)}
    assert t.count() == 39 * 2 * 2
    near = t.join(d, ["source_id", "frame", "det_id"]).select(F.max(F.abs(t.x1 - d.x1))).first()[0]
    assert near < 8


def test_cut_at_pauses_changes_nothing(spark):
    rows = walkers(range(1, 60), gap=30)
    d = spark.createDataFrame(rows, DET)
    got = {(r.frame, r.det_id): r.track_id for r in ST.track(d).collect()}
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in DET.split(", ")])
    whole = Tracker().step({}, pdf)
    assert got == {(r.frame, r.det_id): r.track_id for r in whole.itertuples()} and set(got.values()) == {1, 2, 3, 4}


def test_lost_track_comes_back_with_its_id(spark):
    rows = [r for r in walkers(range(1, 40)) if not 12 <= r[1] <= 16]
    t = ST.track(spark.createDataFrame(rows, DET), Settings(match=0.95)).collect()
    assert {r.track_id for r in t} == {1, 2}


def test_new_track_needs_a_second_sighting(spark):
    rows = walkers(range(1, 20)) + [(0, 10, 9999, 0, 0.9, 500.0, 300.0, 560.0, 400.0)]
    t = ST.track(spark.createDataFrame(rows, DET)).collect()
    assert all(r.det_id != 9999 for r in t)


def test_appearance_and_warp():
    tr = Tracker(Settings(form="xywh"))
    mk = lambda f, x, feat: {"source_id": 0, "frame": f, "det_id": f, "cls": 0, "conf": 0.9, "x1": x, "y1": 0.0, "x2": x + 50, "y2": 80.0, "feat": feat, "warp": [1, 0, 20, 0, 1, 0]}
    pdf = pd.DataFrame([mk(1, 0.0, [1.0, 0.0]), mk(2, 20.0, [1.0, 0.0]), mk(3, 40.0, [1.0, 0.0])])
    pdf.loc[0, "warp"] = None
    pdf["warp"] = [None] + [[1, 0, 20, 0, 1, 0]] * 2
    out = tr.step({}, pdf)
    assert list(out.track_id) == [1, 1, 1]


def test_gating_distance():
    mean, cov = start_track(np.array([0.0, 0, 10, 20]), "xyah")
    d = gating_distance(mean, cov, np.array([[0.0, 0, 10, 20], [50, 0, 60, 20]]))
    assert d[0] < 1e-9 and d[1] > 9.4877
    assert gating_distance(mean, cov, np.array([[3.0, 4, 13, 24]]), only_position=True, metric="gaussian")[0] == 25


def test_tracking_stream_equals_batch(spark, tmp_path):
    rows = walkers(range(1, 25), (0, 1))
    rows.sort(key=lambda r: r[1])
    d = spark.createDataFrame(rows, DET)
    folder = files(spark, rows, DET, str(tmp_path), 16)
    s = ST.source_stream(spark, folder, d.schema, files_per_trigger=1)
    got = ST.run_available(ST.track_stream(s))
    cols = ["source_id", "frame", "track_id", "det_id"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in ST.track(d).select(cols).collect()}


def test_folds_stream_equals_batch_over_many_files(spark, tmp_path):
    rows = [(i % 5, i, float(abs((i * 17 + i % 5 * 29) % 1280 - 640)), float(i % 480), float(i * 13 % 40)) for i in range(300)]
    schema = "track_id bigint, frame bigint, cx double, cy double, angle double"
    d = spark.createDataFrame(rows, schema)
    folder = files(spark, rows, schema, str(tmp_path), 60)
    for step, out in (folds.crossing(fx.LINE), folds.repetitions(8, 20), folds.speed_lock()):
        s = ST.source_stream(spark, folder, d.schema, files_per_trigger=2)
        got = ST.run_available(ST.fold_stream(s, ["track_id"], ["frame"], step, out)).collect()
        want = ST.fold_batch(d, "track_id", ["frame"], step, out).collect()
        assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_rows_are_dropped(spark, tmp_path):
    # lateness is judged by the watermark the previous batch ended with, hence a batch in between
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(at(1), 1), (at(2), 2), (at(200), 3), (at(201), 4), (at(202), 7), (at(203), 8), (at(3), 5), (at(400), 6)]
    folder = files(spark, rows, "ts timestamp, id bigint", str(tmp_path), 2)
    schema = spark.createDataFrame(rows, "ts timestamp, id bigint").schema
    s = ST.event_time(ST.source_stream(spark, folder, schema, files_per_trigger=1), "ts", "10 minutes")
    got = ST.run_available(ST.tumbling_counts(s, "ts", "1 hour", []), "append").collect()
    assert {(r.start, r.n) for r in got} == {(T0, 2), (T0 + dt.timedelta(hours=3), 4)}


def test_latest_only(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, "d")], "source_id bigint, frame bigint, v string")
    assert {r.v for r in ST.latest_only(d).collect()} == {"b", "c", "d"}


def test_live_scores(spark):
    sf = "/root/testdata/sf0.001"
    from visiontables.operators import sequences as S
    from visiontables.plans.poses_queries import refs
    poses = fx.poses(spark, sf).select(F.col("seq_id").alias("track_id"), "frame", "kpts")
    w = ST.fold_batch(poses.where("track_id < 3"), "track_id", ["frame"], *folds.rolling_sequences(8))
    out = ST.score_windows(w, refs(spark, sf), F.lit(1), 60.0, S)
    rows = out.collect()
    assert len(rows) == 9 and all(0 <= r.score <= 100 and r.is_correct == (r.score >= 60) for r in rows)


def test_scores_of_a_stream_equal_the_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    from visiontables.operators import sequences as S
    from visiontables.plans.poses_queries import refs
    poses = fx.poses(spark, sf).select(F.col("seq_id").alias("track_id"), "frame", "kpts").where("track_id < 4").orderBy("frame", "track_id")
    folder = files(spark, poses.collect(), poses.schema, str(tmp_path), 12)
    stream = ST.fold_stream(ST.source_stream(spark, folder, poses.schema, files_per_trigger=1), ["track_id"], ["frame"], *folds.rolling_sequences(8))
    cols = ["track_id", "at_frame", "is_correct", F.round("score", 6)]
    got = ST.run_scores(stream, refs(spark, sf), F.lit(1)).select(*cols).collect()
    w = ST.fold_batch(poses, "track_id", ["frame"], *folds.rolling_sequences(8))
    want = ST.score_windows(w, refs(spark, sf), F.lit(1), 60.0, S).select(*cols).collect()
    assert len(want) == 12 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def walks(n_tracks, hours):
    """Tracks that live for four sightings, one after the other, some of them seen again after a long pause."""
    rows, k = [], 0
    for t in range(n_tracks):
        for s in (0, 1, 2, 3, *((40, 41, 42) if t % 3 == 0 else ())):
            at = t * hours / n_tracks + s * 0.25
            rows.append((t, int(at * 60), 640.0 * (s % 2), 10.0 * s, float(25 - 20 * (s % 2)), T0 + dt.timedelta(minutes=int(at * 60))))
            k += 1
    return sorted(rows, key=lambda r: (r[5], r[0]))


WALK = "track_id bigint, frame bigint, cx double, cy double, angle double, ts timestamp"
PAUSE = 2 * 3_600_000


def test_pauses_end_state_wherever_batches_end(spark, tmp_path):
    rows = walks(40, 60)
    folder = files(spark, rows, WALK, str(tmp_path), 37)
    schema = spark.createDataFrame(rows, WALK).schema
    pdf = pd.DataFrame(rows, columns=["track_id", "frame", "cx", "cy", "angle", "ts"])
    for step, out in (folds.crossing([(320.0, -50.0), (320.0, 480.0)]), folds.repetitions(8, 20), folds.speed_lock(3)):
        want = []
        for _, own in pdf.groupby("track_id"):
            for _, part in own.groupby((own["ts"].diff() > pd.Timedelta(milliseconds=PAUSE)).cumsum()):
                want += map(tuple, step({}, part).itertuples(index=False))
        for per in (1, 100):
            s = ST.event_time(ST.source_stream(spark, folder, schema, files_per_trigger=per), "ts", "10 minutes")
            got = ST.run_available(ST.fold_stream(s, ["track_id"], ["frame"], step, out, pause_ms=PAUSE)).collect()
            assert want and sorted(map(tuple, got)) == sorted(want)


def test_state_stays_small_over_many_files(spark, tmp_path):
    rows = walks(200, 300)
    folder = files(spark, rows, WALK, str(tmp_path / "in"), 25)
    schema = spark.createDataFrame(rows, WALK).schema
    step, out = folds.repetitions(8, 20)
    for windows, per in ((False, 1), (True, 3)):
        s = ST.event_time(ST.source_stream(spark, folder, schema, files_per_trigger=per), "ts", "10 minutes")
        df = ST.tumbling_counts(s, "ts", "1 hour", ["track_id"]) if windows else ST.fold_stream(s, ["track_id"], ["frame"], step, out, pause_ms=PAUSE)
        name = f"{tmp_path}/{len(df.columns)}-{df.columns[-1]}"
        q = df.writeStream.format("parquet").option("path", f"{name}/out").option("checkpointLocation", f"{name}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert len(held) >= 12 and max(held) < 90 and held[-1] < 90


def test_rows_late_after_a_restart(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    day = lambda *ms: spark.createDataFrame([(at(m),) for m in ms], "ts timestamp")
    batches = [day(1, 2, 100), day(3, 95, 130), day().limit(0), day(70, 50, 300)]
    got = ST.run_arrivals(batches, lambda d: ST.tumbling_counts(ST.event_time(d, "ts", "30 minutes"), "ts", "1 hour", []))
    # after 130 the watermark is 100, so what belongs to the first hour is late, and the second hour, which ends at 120, is not
    assert {(r.start, r.n) for r in got.collect()} == {(T0, 2), (at(60), 3), (at(120), 1)}
