"""The frame loop: blobs of a frame are linked to those of the frame before, and tracklets open, go on and close; as a stateful stream and over a table.

A movie is one key: what happens in a frame depends on the frame before it. A stream keeps, per movie, the blobs of the last finished frame, its open tracklets, the rows of
the frame that is still arriving, and a few counters, each in a state of its own. A frame is taken up when a later one arrives, so it does not matter how rows are cut into batches. When a
movie is silent for long in event time, a timer takes up its last frame and closes what is open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BLOB = ["frame", "blob", "x", "y", "area", "dt", "boundary"]
OUT = "movie long, kind string, serial long, other long, fi long, ff long, n long"
OUT_NAMES = ["movie", "kind", "serial", "other", "fi", "ff", "n"]
#: Points of a frame and the one before up to which all pairs are compared.
FEW = 24


@dataclass(frozen=True)
class Rules:
    """fps; greatest speed, and what a cluster's radius is of it; reach: how near two blobs of a crowded cluster must be; area: that of an animal; longest: rows of a
    tracklet (0: any); step: frames between two that are tracked; open_boundary: tracklets part where they begin or cease to touch it."""

    fps: float = 1.0
    max_speed: float = 1.0
    radius: float = 1.0
    scale: float = 1.0
    reach: float = 1.0
    area: float = 0.0
    longest: int = 0
    step: int = 1
    open_boundary: bool = False


@dataclass
class Movie:
    """prev: blobs of the last frame as (serial, x, y, area, boundary); open: serial -> [id, fi, ff, n]."""

    prev: list[tuple] = field(default_factory=list)
    open: dict[int, list] = field(default_factory=dict)
    serial: int = 0
    last: int | None = None


def clusters(xy: np.ndarray, radius: float) -> np.ndarray:
    """The least member of each point's cluster: points nearer than twice the radius are together. Union-find over cells of that width."""
    return np.array(_clusters([complex(x, y) for x, y in xy], radius), int)


def _clusters(at: list[complex], radius: float) -> list[int]:
    """Few points are compared with all before them, many with those of the cells about them."""
    root = list(range(len(at)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach = 2 * radius
    width = max(reach, 1e-12)
    cells: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(at):
        if len(at) <= FEW:
            near = range(i)
        else:
            cx, cy = int(p.real // width), int(p.imag // width)
            near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((cx + dx, cy + dy), ())]
            cells.setdefault((cx, cy), []).append(i)
        for j in near:
            if abs(p - at[j]) <= reach:
                a, b = find(i), find(j)
                if a < b:
                    root[b] = a
                else:
                    root[a] = b
    return [find(i) for i in range(len(at))]


@dataclass
class Frame:
    """Blobs of one frame in order of their number, as lists: frames are many and hold few blobs."""

    frame: int
    at: list[complex]
    area: list[float]
    dt: float
    boundary: list[bool]


def frames_of(rows: pd.DataFrame) -> Iterator[Frame]:
    rows = rows[rows["frame"].notna()]
    rows = rows.iloc[np.lexsort((rows["blob"].to_numpy(), rows["frame"].to_numpy()))]
    frame, x, y, area, dt = (rows[c].to_numpy(t).tolist() for c, t in (("frame", np.int64), ("x", float), ("y", float), ("area", float), ("dt", float)))
    at, touch = list(map(complex, x, y)), rows["boundary"].to_numpy(bool).tolist()
    new = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1)).tolist() if frame else []
    for lo, hi in zip(new, [*new[1:], len(frame)], strict=True):
        yield Frame(frame[lo], at[lo:hi], area[lo:hi], dt[lo], touch[lo:hi])


def link_frames(prev: list[tuple], cur: pd.DataFrame, rules: Rules) -> np.ndarray:
    """(blob before, blob now): which are linked. A cluster with one of either is a link; in others those within reach are, and what is left alone
    finds the only other one left alone, or the only blob whose area changed by an animal."""
    links = np.zeros((len(prev), len(cur)), bool)
    if len(cur):
        now = Frame(0, [complex(x, y) for x, y in zip(cur["x"], cur["y"], strict=True)], cur["area"].to_numpy(float).tolist(), float(cur["dt"].iloc[0]), [])
        for b, parents in enumerate(_parents(prev, now, rules)):
            links[parents, b] = True
    return links


def _parents(prev: list[tuple], cur: Frame, rules: Rules) -> list[list[int]]:
    """Of each blob the blobs before that it is linked to, in order."""
    of: list[list[int]] = [[] for _ in cur.at]
    if not prev or not cur.at:
        return of
    dt = min(max(cur.dt, 1 / rules.fps), 4 / rules.fps)
    members: dict[int, tuple[list[int], list[int]]] = {}
    for i, k in enumerate(_clusters([complex(b[1], b[2]) for b in prev] + cur.at, rules.max_speed * rules.radius * dt / rules.scale)):
        a, b = members.setdefault(k, ([], []))
        (a if i < len(prev) else b).append(i if i < len(prev) else i - len(prev))
    for a, b in members.values():
        if len(a) == 1 and len(b) == 1:
            of[b[0]].append(a[0])
        elif a and b:
            near = _crowded([prev[i] for i in a], [cur.at[i] for i in b], [cur.area[i] for i in b], rules)
            for i, j in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
                of[b[j]].append(a[i])
    return of


def _crowded(prev: list[tuple], at: list[complex], area: list[float], rules: Rules) -> np.ndarray:
    """Links inside a cluster of more than two."""
    p, c, was, now = np.array([b[1:3] for b in prev], float), np.array([(z.real, z.imag) for z in at]), np.array([b[3] for b in prev], float), np.array(area)
    near = np.hypot(*(p[:, None] - c[None]).transpose(2, 0, 1)) <= rules.reach
    lost, new = np.flatnonzero(~near.any(axis=1)), np.flatnonzero(~near.any(axis=0))
    if len(lost) == 1 and len(new) == 1:
        near[lost[0], new[0]] = True
    elif len(lost) == 1 and not len(new):
        gain = now - near.T @ was
        if (gain > rules.area).sum() == 1:
            near[lost[0], np.argmax(gain)] = True
    elif not len(lost) and len(new) == 1:
        loss = was - near @ now
        if (loss > rules.area).sum() == 1:
            near[np.argmax(loss), new[0]] = True
    return near


def take_frame(state: Movie, cur: Frame, rules: Rules) -> Iterator[tuple]:
    """Advance by one frame; yields ('tracklet', serial, id, fi, ff, n) of what closes and ('link', parent, child, frame, None, None)."""
    frame, prev = cur.frame, state.prev
    if state.last is not None and frame - state.last > rules.step:
        yield from _close(state, [b[0] for b in prev])  # frames between without any blob
        prev = []
    parents = _parents(prev, cur, rules)
    children = [0] * len(prev)
    for of in parents:
        for i in of:
            children[i] += 1
    serials = [b[0] for b in prev]
    if cur.dt > 3.5 * rules.fps:
        parents = [[] for _ in parents]
    kept: dict[int, int] = {}
    for j, of in enumerate(parents):
        if len(of) != 1 or children[of[0]] != 1 or cur.dt > 2.5 * rules.fps:
            continue
        full = rules.longest > 0 and state.open[serials[of[0]]][3] >= rules.longest
        parted = rules.open_boundary and prev[of[0]][4] != cur.boundary[j]
        if not full and not parted:
            kept[serials[of[0]]] = j
    used = {state.open[s][0] for s in kept}
    yield from _close(state, [s for s in serials if s not in kept])
    serial_of = [-1] * len(cur.at)
    for s, j in kept.items():
        state.open[s][2:] = [frame, state.open[s][3] + 1]
        serial_of[j] = s
    free, going_on = 1, set(kept.values())
    for j, of in enumerate(parents):
        if j in going_on:
            continue
        while free in used:
            free += 1
        used.add(free)
        serial_of[j], state.serial = state.serial, state.serial + 1
        state.open[serial_of[j]] = [free, frame, frame, 1]
        for i in of:
            yield ("link", serials[i], serial_of[j], frame, None, None)
    state.prev = [(s, z.real, z.imag, a, t) for s, z, a, t in zip(serial_of, cur.at, cur.area, cur.boundary, strict=True)]
    state.last = frame


def _close(state: Movie, serials: list[int]) -> Iterator[tuple]:
    for s in serials:
        ident, fi, ff, n = state.open.pop(s)
        yield ("tracklet", s, ident, fi, ff, n)


def run_frames(state: Movie, rows: pd.DataFrame, rules: Rules, *, to_the_end: bool) -> list[tuple]:
    out = [x for frame in frames_of(rows) for x in take_frame(state, frame, rules)]
    return out + (list(_close(state, sorted(state.open))) if to_the_end else [])


def _table(movie: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(movie, *r) for r in rows], columns=OUT_NAMES)
    return out.astype({c: "Int64" for c in ("movie", "serial", "other", "fi", "ff", "n")})


class FrameLoop(StatefulProcessor):
    """Per movie: ``arriving`` (rows of the newest frame), ``previous`` (blobs of the last one taken up), ``open`` (tracklets by serial) and ``counters``."""

    def __init__(self, rules: Rules, ts: str | None, silent_ms: int):
        self.rules, self.ts, self.silent_ms = rules, ts, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arriving = handle.getListState("arriving", "frame long, blob long, x double, y double, area double, dt double, boundary boolean")
        self.previous = handle.getListState("previous", "serial long, x double, y double, area double, boundary boolean")
        self.open = handle.getMapState("open", "serial long", "id long, fi long, ff long, n long")
        self.counters = handle.getValueState("counters", "serial long, last long")

    def _load(self) -> Movie:
        state = Movie(prev=[tuple(r) for r in self.previous.get()], open={int(k[0]): list(v) for k, v in self.open.iterator()})
        if self.counters.exists():
            state.serial, state.last = self.counters.get()
        return state

    def _store(self, state: Movie, before: set[int]) -> None:
        if state.prev:
            self.previous.put(state.prev)
        for s in before - state.open.keys():
            self.open.removeKey((s,))
        for s, v in state.open.items():
            self.open.updateValue((s,), tuple(v))
        self.counters.update((state.serial, state.last))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        held = [tuple(r) for r in self.arriving.get()]
        new = pd.concat([*([pd.DataFrame(held, columns=BLOB)] if held else []), *[r[BLOB] for r in parts]], ignore_index=True)
        state = self._load()
        before = set(state.open)
        if state.last is not None:
            new = new[new["frame"] > state.last]  # a frame that has been taken up is over
        if len(new):
            newest = new["frame"].max()
            out = run_frames(state, new[new["frame"] < newest], self.rules, to_the_end=False)
            if state.last is not None:
                self._store(state, before)
            self.arriving.put(list(new[new["frame"] == newest].astype(object).itertuples(index=False, name=None)))
            if self.ts:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                seen = max(int(r[self.ts].max().timestamp() * 1000) for r in parts)
                self.handle.registerTimer(max(seen, timerValues.getCurrentWatermarkInMs()) + self.silent_ms)
            yield _table(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        rows = pd.DataFrame([tuple(r) for r in self.arriving.get()], columns=BLOB)
        out = run_frames(state, rows, self.rules, to_the_end=True)
        for held in (self.arriving, self.previous, self.open):
            held.clear()
        state.prev = []
        self.counters.update((state.serial, state.last))  # a movie that goes on later numbers on
        yield _table(key[0], out)

    def close(self) -> None:
        pass


def stream_frames(blobs: DataFrame, rules: Rules, *, ts: str | None = None, late: str = "1 minute", silent_ms: int = 60_000) -> DataFrame:
    """Tracklets as they close, and links between them, of a stream of blobs (movie, frame, blob, x, y, area, dt, boundary[, ts]).

    A movie's frames arrive in order. Rows: kind ``tracklet`` (serial, other: the number on screen, the least that no open tracklet of the frame has, fi, ff, n) and
    ``link`` (serial: parent, other: child, fi: frame). With an event-time column ``ts``, a movie over which the watermark is silent_ms ahead is closed; without one, frames are
    taken up by later ones alone. Needs a state store with column families (RocksDB).
    """
    d = blobs.select("movie", *BLOB, *([ts] if ts else []))
    d = d.withWatermark(ts, late) if ts else d
    return d.groupBy("movie").transformWithStateInPandas(FrameLoop(rules, ts, silent_ms), OUT, "Append", "EventTime" if ts else "None")


def batch_frames(blobs: DataFrame, rules: Rules) -> DataFrame:
    """The same rows from a finished table; a movie is one task."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _table(int(key[0]), run_frames(Movie(), rows[BLOB], rules, to_the_end=True))

    return blobs.select("movie", *BLOB).groupBy("movie").applyInPandas(work, OUT)
