"""State steps shared by batch scans and streams: ``step(state, rows, last) -> rows`` with a plain dict as state."""

from __future__ import annotations

import math
from collections.abc import Callable, Collection, Sequence

import pandas as pd


class RowStep:
    """A step made of one function a row: ``each(state, *values)`` gives result rows, ``values`` being the columns ``uses``.

    At the positions ``fresh`` the state starts afresh, so a key that pauses often costs no table for each of its stretches.
    """

    def __init__(self, each: Callable[..., list], uses: Sequence[str], columns: Sequence[str]):
        self.each, self.uses, self.columns = each, list(uses), list(columns)

    def __call__(self, state: dict, pdf: pd.DataFrame, _last: bool = False) -> pd.DataFrame:
        return pd.DataFrame(self.rows(state, pdf), columns=self.columns)

    def rows(self, state: dict, pdf: pd.DataFrame, fresh: Collection[int] = ()) -> list[tuple]:
        out = []
        for i, values in enumerate(zip(*[pdf[c].tolist() for c in self.uses])):
            if i in fresh:
                state.clear()
            out += self.each(state, *values)
        return out


def _side(ax, ay, bx, by, px, py):
    v = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return (v > 0) - (v < 0)


def _touches(p, q, a, b) -> bool:
    d = _side(*a, *b, *p), _side(*a, *b, *q), _side(*p, *q, *a), _side(*p, *q, *b)
    if d[0] * d[1] < 0 and d[2] * d[3] < 0:
        return True
    on = lambda u, v, w: min(u[0], v[0]) <= w[0] <= max(u[0], v[0]) and min(u[1], v[1]) <= w[1] <= max(u[1], v[1])
    return (d[0] == 0 and on(a, b, p)) or (d[1] == 0 and on(a, b, q)) or (d[2] == 0 and on(p, q, a)) or (d[3] == 0 and on(p, q, b))


def crossing(line: list[tuple[float, float]], key: str = "track_id"):
    """First crossing of a line per track: (key, frame, direction)."""
    a, b = line
    sideways = abs(a[0] - b[0]) < abs(a[1] - b[1])

    def each(state: dict, k, frame, cx, cy) -> list:
        now, prev = (cx, cy), state.get("at")
        state["at"] = now
        if prev is None or state.get("counted") or not _touches(prev, now, a, b):
            return []
        state["counted"] = True
        return [(k, frame, "IN" if (now[0] > prev[0] if sideways else now[1] > prev[1]) else "OUT")]

    step = RowStep(each, [key, "frame", "cx", "cy"], [key, "frame", "direction"])
    return step, f"{key} bigint, frame bigint, direction string"


def repetitions(down: float, up: float, key: str = "track_id"):
    """One row per completed repetition with the running count."""
    def each(state: dict, k, frame, angle) -> list:
        out = []
        if angle < down:
            if state.get("stage") == "up":
                state["n"] = state.get("n", 0) + 1
                out.append((k, frame, state["n"]))
            state["stage"] = "down"
        elif angle > up:
            state["stage"] = "up"
        return out

    step = RowStep(each, [key, "frame", "angle"], [key, "frame", "reps"])
    return step, f"{key} bigint, frame bigint, reps bigint"


def speed_lock(n: int = 5, fps: float = 30, meters_per_pixel: float = 0.05, cap: int = 120, key: str = "track_id"):
    """Speed fixed at the n-th sighting of a track; the state is the first sighting and a count."""
    def each(state: dict, k, frame, cx, cy) -> list:
        if state.get("locked"):
            return []
        state.setdefault("first", (cx, cy, frame))
        state["n"] = state.get("n", 0) + 1
        x, y, f = state["first"]
        if state["n"] != n or frame <= f:
            return []
        state["locked"] = True
        pace = math.hypot(cx - x, cy - y) * meters_per_pixel / ((frame - f) / fps) * 3.6
        return [(k, frame, int(min(pace, cap)))]

    step = RowStep(each, [key, "frame", "cx", "cy"], [key, "frame", "speed"])
    return step, f"{key} bigint, frame bigint, speed int"


def rolling_sequences(n: int, skip: int = 1, key: str = "track_id"):
    """Every full window of the last n poses of a track as rows (key, at_frame, frame, kpts)."""
    def step(state: dict, pdf: pd.DataFrame, _last: bool = False) -> pd.DataFrame:
        out, window = [], state.setdefault("window", [])
        for r in pdf.itertuples(index=False):
            if r.frame % skip:
                continue
            window.append([{k: (None if v is None else float(v)) for k, v in dict(p).items()} for p in r.kpts])
            del window[:-n]
            if len(window) == n:
                out += [(getattr(r, key), r.frame, i, w) for i, w in enumerate(window)]
        return pd.DataFrame(out, columns=[key, "at_frame", "frame", "kpts"])

    return step, f"{key} bigint, at_frame bigint, frame bigint, kpts array<struct<x:double,y:double,c:double>>"
