"""How many animals each tracklet holds, and how many pass an open boundary; one group of movies of a colony per task.

The rules are looked at in the order of nodes (fi, tracklet), and a count counts at once for the nodes behind it, so a group is a sequential
kernel as in ``solve``; groups are spread by Spark, and links between groups are not followed. A heap of (sweep, node) holds what may have changed,
in the order in which whole sweeps would meet it.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = "tracklet long, nants double, exits double, entrances double"


class Group:
    """Nodes by position, and who stands beside whom: siblings share a parent, coparents a child."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        self.nodes = nodes.sort_values(["fi", "tracklet"], kind="stable").reset_index(drop=True)
        at = {t: i for i, t in enumerate(self.nodes["tracklet"])}
        up, down = defaultdict(set), defaultdict(set)
        for a, b in zip(edges["src"], edges["dst"], strict=True):
            if a in at and b in at:
                down[at[a]].add(at[b])
                up[at[b]].add(at[a])
        every = range(len(at))
        self.up, self.down = [up[n] for n in every], [down[n] for n in every]
        self.n: list[float] = [math.nan] * len(at)

    def beside(self, n: int, to: list[set], back: list[set]) -> set[int]:
        return {m for p in to[n] for m in back[p]} - {n}

    def known(self, some: set[int]) -> bool:
        return all(not math.isnan(self.n[m]) for m in some)

    def total(self, some: set[int]) -> float:
        return math.fsum(self.n[m] for m in some)

    def told(self, some: set[int]) -> float:
        """The sum of what is known."""
        return math.fsum(self.n[m] for m in some if not math.isnan(self.n[m]))

    def from_side(self, n: int, to: list[set], back: list[set]) -> float:
        """The sum of one side less that of those beside, if all are known and have no other links there."""
        if not to[n] or not self.known(to[n]):
            return math.nan
        others = self.beside(n, to, back)
        if not self.known(others) or (others and {p for m in others for p in to[m]} != to[n]):
            return math.nan
        return self.total(to[n]) - self.total(others)

    def settle(self, closed: list[bool]) -> None:
        """Counts of nodes off the boundary from their parents, or else their children, until none is told anew."""
        todo = [(0, n) for n in range(len(self.n)) if closed[n] and math.isnan(self.n[n])]
        queued = set(todo)
        while todo:
            sweep, n = item = heapq.heappop(todo)
            queued.discard(item)
            if not math.isnan(self.n[n]):
                continue
            parents = self.from_side(n, self.up, self.down)
            self.n[n] = self.from_side(n, self.down, self.up) if math.isnan(parents) else parents
            if math.isnan(self.n[n]):
                continue
            near = self.up[n] | self.down[n] | self.beside(n, self.up, self.down) | self.beside(n, self.down, self.up)
            for m in near:
                item = (sweep if m > n else sweep + 1, m)
                if closed[m] and math.isnan(self.n[m]) and item not in queued:
                    queued.add(item)
                    heapq.heappush(todo, item)

    def split_diamonds(self) -> None:
        """Nodes that share all their parents and all their children, and nothing else does: alike parts of what the parents hold, or else the children."""
        before = list(self.n)
        for n in range(len(before)):
            if not math.isnan(before[n]):
                continue
            sides = self.beside(n, self.up, self.down) | {n}
            if sides != self.beside(n, self.down, self.up) | {n}:
                continue
            top, bottom = {p for m in sides for p in self.up[m]}, {c for m in sides for c in self.down[m]}
            if {m for p in top for m in self.down[p]} != sides or {m for c in bottom for m in self.up[c]} != sides:
                continue
            above, below = math.fsum(before[p] for p in top), math.fsum(before[c] for c in bottom)
            self.n[n] = (below if math.isnan(above) else above) / len(sides)

    def at_least(self, n: int, to: list[set], back: list[set]) -> float:
        """The least flow at one side: what is known of all ends there less what is known beside, one at least."""
        others = self.beside(n, to, back)
        return max(1.0, self.told({p for m in others for p in to[m]}) - self.told(others))

    def flow(self, n: int, to: list[set], back: list[set]) -> float:
        """What one side leaves for a node, one at least."""
        rest = self.total(to[n]) - self.total(self.beside(n, to, back))
        return 1.0 if math.isnan(rest) else max(1.0, rest)

    def own_side(self, n: int, to: list[set], back: list[set]) -> bool:
        """Whether one side is known, and those beside have no links elsewhere."""
        return self.known(to[n]) and all(to[m] <= to[n] for m in self.beside(n, to, back))

    def cross_boundary(self, touching: list[bool]) -> tuple[list[float], list[float]]:
        """(out of the boundary, into it) of the nodes that touch it, which get their counts here."""
        out, into = [0.0] * len(self.n), [0.0] * len(self.n)
        for n in range(len(self.n)):
            parents, children = self.up[n], self.down[n]
            if not touching[n] or not (parents or children):
                continue
            above, below = (self.up, self.down), (self.down, self.up)
            if not parents:
                sure = self.own_side(n, *below) and self.known(self.beside(n, *below))
                self.n[n] = out[n] = self.flow(n, *below) if sure else self.at_least(n, *below)
            elif not children:
                sure = self.own_side(n, *above) and self.known(self.beside(n, *above))
                self.n[n] = into[n] = self.flow(n, *above) if sure else self.at_least(n, *above)
            else:
                law = self.flow if self.own_side(n, *above) and self.own_side(n, *below) else self.at_least
                came, went = law(n, *above), law(n, *below)
                self.n[n], into[n], out[n] = came, max(came - went, 0.0), max(went - came, 0.0)
        return out, into


def count_group(nodes: pd.DataFrame, edges: pd.DataFrame, small: float) -> pd.DataFrame:
    g = Group(nodes, edges)
    touching = g.nodes["touching"].to_numpy(bool).tolist()
    for n, (area, single) in enumerate(zip(g.nodes["area"], g.nodes["single"], strict=True)):
        slight = area < small  # not so where the area is unknown
        if not g.up[n] and not g.down[n] and slight:
            g.n[n] = 0.0
        elif single or (len(g.up[n]) <= 1 and len(g.down[n]) <= 1 and slight):
            g.n[n] = 1.0
    g.settle([not t for t in touching])
    g.split_diamonds()
    out, into = g.cross_boundary(touching)
    return pd.DataFrame({"tracklet": g.nodes["tracklet"], "nants": g.n, "exits": out, "entrances": into})


def infer_counts(nodes: DataFrame, edges: DataFrame, *, small: float) -> DataFrame:
    """(tracklet, nants, exits, entrances), nants NULL where nothing tells.

    Singles hold 1, slight tracklets (mean area below ``small``) 0 if they have no link and 1 if they have at most one on either side. A node off the boundary holds
    the sum of its parents less its siblings, if all are known and the siblings have the same parents; else the same along children. Nodes with the
    same parents and the same children share these alike. A node that touches the open boundary holds what its links leave for it, one at least;
    what begins there came out of the boundary (exits), what ends there went into it (entrances), and in between the difference did.

    nodes: (tracklet, area, single[, touching, fi, colony, grp]); edges: (src, dst), each link once.
    """
    plain = {"touching": F.lit(False), "fi": F.lit(0).cast("long"), "colony": F.lit(0).cast("long"), "grp": F.lit(0).cast("long")}
    d = nodes.withColumns({c: x for c, x in plain.items() if c not in nodes.columns})
    n = d.select("colony", "grp", "tracklet", "fi", F.col("area").cast("double").alias("area"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("single", "touching")])
    e = edges.select("src", "dst").join(d.select(F.col("tracklet").alias("src"), "colony", "grp"), "src")
    every = n.withColumn("is_node", F.lit(True)).unionByName(e.withColumn("is_node", F.lit(False)), True)

    def work(df: pd.DataFrame) -> pd.DataFrame:
        part, links = df[df["is_node"]].reset_index(drop=True), df.loc[~df["is_node"], ["src", "dst"]].astype("int64")
        part[["tracklet", "fi"]], part[["single", "touching"]] = part[["tracklet", "fi"]].astype("int64"), part[["single", "touching"]].astype(bool)
        return count_group(part, links, small)

    return every.groupBy("colony", "grp").applyInPandas(work, COUNTS).withColumn("nants", F.nanvl("nants", F.lit(None).cast("double")))


def boundary_times(tracks: DataFrame, counts: DataFrame) -> DataFrame:
    """(tracklet, kind, frame, nants): when and how many left and entered; the frame is the tracklet's first, as in the published tables."""
    d = counts.join(tracks.select("tracklet", F.col("fi").alias("frame")), "tracklet")
    side = lambda c, kind: d.where(F.col(c) > 0).select("tracklet", F.lit(kind).alias("kind"), "frame", F.col(c).alias("nants"))
    return side("exits", "exit").union(side("entrances", "entrance"))
