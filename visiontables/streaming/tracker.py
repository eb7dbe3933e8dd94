"""Multi-object tracking of one source as a fold over its frames: numbers only, no pixels.

The state is a plain dict, small whatever the length of the video, and the same step serves batch and stream. The tracks of a
source are arrays with one entry a track, in the order in which they began, so a frame is some array steps and not a loop over tracks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from visiontables.functions.assignment import assign

TRACKED, LOST, REMOVED = 1, 2, 3
POS, VEL = 1 / 20, 1 / 160
MOTION = np.eye(8) + np.eye(8, k=4)
COLUMNS = ["source_id", "frame", "track_id", "x1", "y1", "x2", "y2", "conf", "cls", "det_id"]
SCHEMA = "source_id bigint, frame bigint, track_id bigint, x1 double, y1 double, x2 double, y2 double, conf double, cls int, det_id bigint"


@dataclass(frozen=True)
class Settings:
    """Thresholds of the association stages; the values are the usual defaults."""

    high: float = 0.25
    low: float = 0.1
    new: float = 0.25
    buffer: int = 30
    match: float = 0.8
    second: float = 0.5
    unconfirmed: float = 0.7
    fuse: bool = True
    form: str = "xyah"
    proximity: float = 0.5
    appearance: float = 0.25
    ema: float = 0.9


#: One entry a track; ``feat`` (a list) is there only where detections have one.
FIELDS = {"mean": (float, 8), "cov": (float, 8, 8), "id": (np.int64,), "state": (np.int8,), "confirmed": (bool,), "start": (np.int64,), "seen": (np.int64,),
          "conf": (float,), "cls": (np.int64,), "det_id": (np.int64,)}


def _measure(box: np.ndarray, form: str) -> np.ndarray:
    """Centre, aspect (or width) and height of boxes, one a row."""
    w, h = box[..., 2] - box[..., 0], box[..., 3] - box[..., 1]
    return np.stack([box[..., 0] + w / 2, box[..., 1] + h / 2, w / h if form == "xyah" else w, h], -1)


def _corners(mean: np.ndarray, form: str) -> np.ndarray:
    w = mean[..., 2] * mean[..., 3] if form == "xyah" else mean[..., 2]
    return np.stack([mean[..., 0] - w / 2, mean[..., 1] - mean[..., 3] / 2, mean[..., 0] + w / 2, mean[..., 1] + mean[..., 3] / 2], -1)


def _variance(mean: np.ndarray, form: str, ratio: float, pos: float, vel: float | None = None, ratio_vel: float = 1e-5) -> np.ndarray:
    h = mean[..., 3]
    w, one = (h, np.ones_like(h)) if form == "xyah" else (mean[..., 2], None)
    third = lambda s, fixed: s * w if one is None else fixed * one
    std = [pos * w, pos * h, third(pos, ratio), pos * h]
    if vel is not None:
        std += [vel * w, vel * h, third(vel, ratio_vel), vel * h]
    return np.square(np.stack(std, -1))


def _noise(mean: np.ndarray, form: str, ratio: float, pos: float, vel: float | None = None) -> np.ndarray:
    v = _variance(mean, form, ratio, pos, vel)
    return v[..., None] * np.eye(v.shape[-1])


def start_track(box, form):
    m = _measure(box, form)
    return np.concatenate([m, np.zeros_like(m)], -1), _noise(m, form, 1e-2, 2 * POS, 10 * VEL)


def predict(t: dict, pool: np.ndarray, form: str) -> None:
    """Move the tracks of ``pool`` one frame on; a lost track no longer changes its size."""
    if not len(pool):
        return
    mean, lost = t["mean"][pool], t["state"][pool] != TRACKED
    mean[lost, 7] = 0
    if form == "xywh":
        mean[lost, 6] = 0
    cov = MOTION @ t["cov"][pool] @ MOTION.T
    cov[:, range(8), range(8)] += _variance(mean, form, 1e-2, POS, VEL)
    t["mean"][pool], t["cov"][pool] = mean @ MOTION.T, cov


def correct(t: dict, rows: np.ndarray, box: np.ndarray, form: str) -> None:
    """Pull the tracks ``rows`` to the boxes that they took."""
    mean, cov = t["mean"][rows], t["cov"][rows]
    inner = cov[:, :4, :4] + _noise(mean, form, 1e-1, POS)
    gain = np.linalg.solve(inner, cov[:, :, :4].transpose(0, 2, 1)).transpose(0, 2, 1)
    t["mean"][rows] = mean + (gain @ (_measure(box, form) - mean[:, :4])[:, :, None])[:, :, 0]
    t["cov"][rows] = cov - gain @ inner @ gain.transpose(0, 2, 1)


def gating_distance(mean: np.ndarray, cov: np.ndarray, boxes: np.ndarray, form: str = "xyah", only_position: bool = False,
                    metric: str = "maha") -> np.ndarray:
    """Distance of measurements (corner boxes) from a predicted state: squared Mahalanobis or Euclidean."""
    n = 2 if only_position else 4
    diff = _measure(boxes, form)[:, :n] - mean[:n]
    if metric == "gaussian":
        return (diff ** 2).sum(1)
    inner = (cov[:4, :4] + _noise(mean, form, 1e-1, POS))[:n, :n]
    return (np.linalg.solve(inner, diff.T).T * diff).sum(1)


def _iou_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return 1 - inter / (size(a)[:, None] + size(b)[None] - inter + 1e-7)


class Tracker:
    """Fold step: ``state`` holds the tracks' arrays, the next id and the last frame."""

    def __init__(self, settings: Settings = Settings()):
        self.s = settings

    def cost(self, t, rows, dets, cols, looks=True):
        d = _iou_distance(_corners(t["mean"][rows], self.s.form), dets["box"][cols])
        far = d > 1 - self.s.proximity
        if self.s.fuse and d.size:
            d = 1 - (1 - d) * dets["conf"][cols]
        feats = ([t["feat"][i] for i in rows], [dets["feat"][j] for j in cols]) if looks and d.size and "feat" in dets else None
        if feats and all(f is not None for side in feats for f in side):
            a, b = np.stack(feats[0]), np.stack(feats[1])
            e = np.maximum(0, 1 - a @ b.T) / 2
            e[(e > 1 - self.s.appearance) | far] = 1.0
            d = np.minimum(d, e)
        return d

    def associate(self, t, rows, dets, cols, limit, frame, looks=True):
        """Match tracks ``rows`` with detections ``cols``, update the matched, return what is left on both sides."""
        pairs = np.array(assign(self.cost(t, rows, dets, cols, looks), limit), dtype=np.intp).reshape(-1, 2) if len(rows) and len(cols) else ()
        if len(pairs):
            self.take(t, rows[pairs[:, 0]], dets, cols[pairs[:, 1]], frame)
            rows, cols = np.delete(rows, pairs[:, 0]), np.delete(cols, pairs[:, 1])
        return rows, cols

    def take(self, t, rows, dets, cols, frame):
        correct(t, rows, dets["box"][cols], self.s.form)
        t["state"][rows], t["confirmed"][rows], t["seen"][rows] = TRACKED, True, frame
        for c in ("conf", "cls", "det_id"):
            t[c][rows] = dets[c][cols]
        for i, j in zip(rows, cols) if "feat" in dets else ():
            if dets["feat"][j] is not None:
                f = self.s.ema * t["feat"][i] + (1 - self.s.ema) * dets["feat"][j] if t["feat"][i] is not None else dets["feat"][j]
                t["feat"][i] = f / max(np.linalg.norm(f), 1e-12)

    def begin(self, state, dets, cols, frame, first):
        """New tracks behind the others, numbered on."""
        t, n = state["tracks"], len(cols)
        mean, cov = start_track(dets["box"][cols], self.s.form)
        new = {"mean": mean, "cov": cov, "id": state.get("next", 0) + 1 + np.arange(n), "state": np.full(n, TRACKED), "confirmed": np.full(n, first),
               "start": np.full(n, frame), "seen": np.full(n, frame), **{c: dets[c][cols] for c in ("conf", "cls", "det_id")}}
        for c, (kind, *_) in FIELDS.items():
            t[c] = np.concatenate([t[c], new[c].astype(kind, copy=False)])
        own = [dets["feat"][j] for j in cols] if "feat" in dets else [None] * n
        t["feat"] += [f if f is None else f / max(np.linalg.norm(f), 1e-12) for f in own]
        state["next"] = state.get("next", 0) + n

    def frame(self, state, frame, dets, warp=None, first=False):
        s = self.s
        t = state.setdefault("tracks", {c: np.zeros((0, *shape), kind) for c, (kind, *shape) in FIELDS.items()} | {"feat": []})
        high = np.flatnonzero(dets["conf"] >= s.high)
        low = np.flatnonzero((dets["conf"] > s.low) & (dets["conf"] < s.high))
        live = t["state"] == TRACKED
        fresh = np.flatnonzero(live & ~t["confirmed"])
        pool = np.concatenate([np.flatnonzero(live & t["confirmed"]), np.flatnonzero(t["state"] == LOST)])
        predict(t, pool, s.form)
        if warp is not None:
            turn = np.kron(np.eye(4), warp[:, :2])
            all_ = np.concatenate([pool, fresh])
            t["mean"][all_], t["cov"][all_] = t["mean"][all_] @ turn.T, turn @ t["cov"][all_] @ turn.T
            t["mean"][all_, :2] += warp[:, 2]
        left, high = self.associate(t, pool, dets, high, s.match, frame)
        missed, _ = self.associate(t, left[t["state"][left] == TRACKED], dets, low, s.second, frame, looks=False)
        t["state"][missed] = LOST
        gone, high = self.associate(t, fresh, dets, high, s.unconfirmed, frame)
        t["state"][gone] = REMOVED
        new = high[dets["conf"][high] >= s.new]
        if len(new):
            self.begin(state, dets, new, frame, first)
        t["state"][(t["state"] == LOST) & (frame - t["seen"] > s.buffer)] = REMOVED
        self.drop_doubles(t)
        stays = t["state"] != REMOVED
        if not stays.all():
            t["feat"] = [f for f, kept in zip(t["feat"], stays) if kept]
            t.update({c: t[c][stays] for c in FIELDS})

    def drop_doubles(self, t):
        a, b = np.flatnonzero(t["state"] == TRACKED), np.flatnonzero(t["state"] == LOST)
        if not len(a) or not len(b):
            return
        i, j = np.nonzero(_iou_distance(_corners(t["mean"][a], self.s.form), _corners(t["mean"][b], self.s.form)) < 0.15)
        age = t["seen"] - t["start"]
        longer = age[a[i]] > age[b[j]]
        t["state"][np.where(longer, b[j], a[i])] = REMOVED

    def step(self, state: dict, pdf: pd.DataFrame, _last: bool = False) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values("frame", kind="stable") if not pdf["frame"].is_monotonic_increasing else pdf
        frames = pdf["frame"].to_numpy(dtype=np.int64)
        columns = {"box": pdf[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), "conf": pdf["conf"].to_numpy(dtype=float),
                   "cls": pdf["cls"].to_numpy(dtype=np.int64), "det_id": pdf["det_id"].to_numpy(dtype=np.int64)}
        if "feat" in pdf:
            columns["feat"] = [None if f is None else np.asarray(f, float) for f in pdf["feat"]]
        none = {c: v[:0] for c, v in columns.items()}
        edges = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
        for lo, hi in zip(edges[:-1], edges[1:]) if len(frames) else ():
            frame = int(frames[lo])
            last = state.get("frame")
            # frames without rows still age the tracks; beyond the buffer there is nothing left to age
            for f in range(last + 1, min(frame, last + self.s.buffer + 2)) if last is not None else ():
                self.frame(state, f, none)
            first = last is None and ("opens" not in pdf or bool(pdf["opens"].iloc[lo]))
            state["frame"] = frame
            warp = pdf["warp"].iloc[lo] if "warp" in pdf else None
            self.frame(state, frame, {c: v[lo:hi] for c, v in columns.items()}, None if warp is None else np.asarray(warp, float).reshape(2, 3), first)
            t = state["tracks"]
            shown = np.flatnonzero((t["state"] == TRACKED) & t["confirmed"])
            out.append((np.full(len(shown), pdf["source_id"].iloc[lo]), np.full(len(shown), frame), t["id"][shown], *_corners(t["mean"][shown], self.s.form).T,
                        t["conf"][shown], t["cls"][shown], t["det_id"][shown]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(COLUMNS, zip(*out))}, columns=COLUMNS)
