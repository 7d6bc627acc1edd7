"""The tracklet graph: nodes (tracklet, colony, fi, ff, ...) and edges (src, dst) from parent to child in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.components import connected_components, cut
from trailmark.operators.intervals import overlap_join


def build_edges(links: DataFrame, names: DataFrame) -> DataFrame:
    """Edges by number from links (parent, child) by name and names (name, tracklet); unknown ends drop out."""
    s, d = names.select(F.col("name").alias("parent"), F.col("tracklet").alias("src")), names.select(F.col("name").alias("child"), F.col("tracklet").alias("dst"))
    return links.join(s, "parent").join(d, "child").select("src", "dst").distinct()


def subgraph(edges: DataFrame, nodes: DataFrame, on: str = "tracklet") -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes, edges.src == nodes[on], "left_semi").join(nodes, edges.dst == nodes[on], "left_semi")


def siblings(edges: DataFrame) -> DataFrame:
    """(a, b): different nodes with a common parent."""
    x, y = edges.select("src", F.col("dst").alias("a")), edges.select("src", F.col("dst").alias("b"))
    return x.join(y, "src").where("a <> b").select("a", "b").distinct()


def coparents(edges: DataFrame) -> DataFrame:
    """(a, b): different nodes with a common child."""
    return siblings(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tracklet, component): the least node number that each node reaches along edges in either direction."""
    c = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("tracklet").join(c, F.col("tracklet") == F.col("node"), "left").select("tracklet", F.coalesce("component", "tracklet").alias("component"))


def hop_distance(edges: DataFrame, depth: int, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops): shortest directed distances from 1 to depth; each round joins the last frontier only.

    The links are worked out once and written, as every round reads them.
    """
    e = cut(edges.select("src", "dst").distinct())
    front = e if sources is None else e.join(sources.select(F.col("tracklet").alias("src")), "src", "left_semi")
    front = cut(front.withColumn("hops", F.lit(1)))
    known, step = front, e.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    for k in range(2, depth + 1):
        new = front.join(step, "dst").select("src", F.col("to").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti")
        front = cut(new.withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        known = known.union(front)
    return known


def descendants(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    return hop_distance(edges, depth, sources).select("src", "dst").where("src <> dst")


def bottleneck_pairs(nodes: DataFrame, edges: DataFrame, *, depth: int = 10) -> DataFrame:
    """(src, dst, hops): pairs through which everything that leaves src and reaches dst must pass.

    src has more than one parent. At distance 1: src has one child and dst one parent. Beyond: each node alive
    strictly between is reached from src iff it reaches dst; no contemporary of src reaches dst; src reaches no
    contemporary of dst.
    """
    reach = cut(hop_distance(edges, depth))
    n = nodes.select("tracklet", "colony", "fi", "ff")
    i = edges.groupBy(F.col("dst").alias("tracklet")).agg(F.count(F.lit(1)).alias("indeg"))
    o = edges.groupBy(F.col("src").alias("tracklet")).agg(F.count(F.lit(1)).alias("outdeg"))
    s = n.join(i.where("indeg > 1"), "tracklet").join(o, "tracklet", "left").select(F.col("tracklet").alias("src"), "colony", F.col("fi").alias("s_fi"), F.col("ff").alias("s_ff"), "outdeg")
    t = n.join(i, "tracklet").select(F.col("tracklet").alias("dst"), F.col("fi").alias("t_fi"), F.col("ff").alias("t_ff"), F.col("indeg").alias("t_in"))
    pairs = cut(reach.join(s, "src").join(t, "dst"))
    near = pairs.where("hops = 1 and outdeg = 1 and t_in = 1").select("src", "dst", "hops")
    far = pairs.where("hops > 1")
    pair = ["src", "dst"]
    # who is alive strictly between, with src and with dst: one join of blocks of frames for the three
    asked = lambda about, fi, ff: far.select("colony", "src", "dst", F.lit(about).alias("about"), fi.alias("fi"), ff.alias("ff"))
    ask = asked("gap", F.col("s_ff") + 1, F.col("t_fi") - 1).union(asked("src", F.col("s_fi"), F.col("s_ff"))).union(asked("dst", F.col("t_fi"), F.col("t_ff")))
    mid = overlap_join(ask, n.withColumnRenamed("tracklet", "mid"), ["colony"], width=32).select(F.col("src_a").alias("src"), F.col("dst_a").alias("dst"), F.col("about_a").alias("about"), F.col("mid_b").alias("mid"))
    mid = mid.where("case about when 'gap' then mid <> src and mid <> dst when 'src' then mid <> src else mid <> dst end")
    r1, r2 = reach.select("src", F.col("dst").alias("mid"), F.lit(True).alias("from_s")), reach.select(F.col("src").alias("mid"), "dst", F.lit(True).alias("to_t"))
    mid = mid.join(r1, ["src", "mid"], "left").join(r2, ["mid", "dst"], "left")
    odd = mid.where("case about when 'gap' then coalesce(from_s, false) <> coalesce(to_t, false) when 'src' then to_t is not null else from_s is not null end").select(*pair)
    good = far.select("src", "dst", "hops").join(odd.distinct(), pair, "left_anti")
    return near.union(good)


def component_scores(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per (colony, id, component): size, span, mean assigned, sources, greatest source score and its rank score.

    parts: (colony, id, component, tracklet); nodes: (tracklet, fi, ff, score, source, assigned).
    """
    g = parts.join(nodes, "tracklet").groupBy("colony", "id", "component").agg(
        F.count(F.lit(1)).alias("size"), F.min("fi").alias("fi"), F.max("ff").alias("ff"), F.avg(F.col("assigned").cast("double")).alias("assigned"),
        F.count_if("source").alias("sources"), F.coalesce(F.max(F.when(F.col("source"), F.col("score"))), F.lit(0.1)).alias("best"),
    )
    return g.withColumn("score", (F.col("ff") - F.col("fi") + 1) * (0.1 + F.col("assigned")) * (0.1 + F.col("sources")) * F.col("best"))


def _swept(keep: DataFrame, alive: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of ``alive`` reachable from ``keep`` along edges; a round follows the links of the last round's nodes only.

    There are as many rounds as links on the longest shortest path, in chunks of movies a few hundred at most.
    """
    known = front = cut(keep)
    rounds = 0
    while True:
        step = front.join(edges, front.tracklet == edges.src).select(F.col("dst").alias("tracklet")).distinct()
        front = cut(step.join(alive, "tracklet", "left_semi").join(known, "tracklet", "left_anti"))
        if front.isEmpty():
            return known
        rounds += 1
        known = known.union(front) if rounds % 8 else cut(known.union(front))


def prune_components(parts: DataFrame, nodes: DataFrame, edges: DataFrame, *, margin: int = 100) -> DataFrame:
    """Nodes that remain after dropping those not reachable from a root near their component's start, then those
    that reach no leaf near its end. parts: (tracklet, component)."""
    d = parts.join(nodes.select("tracklet", "fi", "ff"), "tracklet")
    span = d.groupBy("component").agg(F.min("fi").alias("c_fi"), F.max("ff").alias("c_ff"))
    d = cut(d.join(span, "component"))
    e = cut(subgraph(edges.select("src", "dst"), d))
    roots = d.join(e, d.tracklet == e.dst, "left_anti").where(F.col("fi") < F.col("c_fi") + margin).select("tracklet")
    one = _swept(roots, d.select("tracklet"), e)
    d2 = d.join(one, "tracklet", "left_semi")
    e2 = cut(subgraph(e, d2))
    leaves = d2.join(e2, d2.tracklet == e2.src, "left_anti").where(F.col("ff") > F.col("c_ff") - margin).select("tracklet")
    return _swept(leaves, d2.select("tracklet"), e2.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def merge(nodes: list[DataFrame], edges: list[DataFrame], links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graphs of several movies as one, with links (src, dst) between them whose ends both exist."""
    n, e = nodes[0], edges[0].select("src", "dst")
    for x in nodes[1:]:
        n = n.unionByName(x)
    for x in edges[1:]:
        e = e.union(x.select("src", "dst"))
    return n, e.union(subgraph(links.select("src", "dst"), n)).distinct()


def slice_time(nodes: DataFrame, edges: DataFrame, fi: int, ff: int) -> tuple[DataFrame, DataFrame]:
    n = nodes.where((F.col("fi") <= ff) & (F.col("ff") >= fi))
    return n, subgraph(edges, n)


def build_chains(links: DataFrame, nodes: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """(node, chain, pos): maximal runs of links where the source has one child and the target one parent.

    Pointer doubling: after k rounds a node knows its ancestor 2**k links back.
    """
    from trailmark.streaming.lifecycle import continuations

    up = continuations(links).select(F.col("dst").alias("node"), F.col("src").alias("up"))
    d = cut(nodes.select("node").join(up, "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("pos")))
    for _ in range(max_rounds):
        above = d.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("pos").alias("more"))
        new = cut(d.join(above, "up").select("node", F.col("top").alias("up"), (F.col("pos") + F.col("more")).alias("pos")))
        if new.agg(F.sum("pos")).first() == d.agg(F.sum("pos")).first():
            break
        d = new
    return d.select("node", F.col("up").alias("chain"), "pos")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the tracklets of ``gone``; their links go too."""
    n = nodes.join(gone.select("tracklet"), "tracklet", "left_anti")
    g = gone.select("tracklet")
    return n, edges.join(g, edges.src == g.tracklet, "left_anti").join(g, edges.dst == g.tracklet, "left_anti")


def add_links(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """edges with links (src, dst) whose ends exist and whose target begins after the source ends."""
    n = lambda s: nodes.select(F.col("tracklet").alias(s), F.col("fi" if s == "dst" else "ff").alias(f"__{s}"))
    ok = links.select("src", "dst").join(n("src"), "src").join(n("dst"), "dst").where("__dst > __src").select("src", "dst")
    return edges.select("src", "dst").union(ok).distinct()


def rename_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with tracklets renumbered by names (tracklet, new); those without a new number keep theirs."""
    to = lambda c: names.select(F.col("tracklet").alias(c), F.col("new").alias(f"__{c}"))
    n = nodes.join(to("tracklet"), "tracklet", "left").withColumn("tracklet", F.coalesce("__tracklet", "tracklet")).drop("__tracklet")
    e = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    return n, e.withColumns({"src": F.coalesce("__src", "src"), "dst": F.coalesce("__dst", "dst")}).drop("__src", "__dst")


def split_nodes(nodes: DataFrame, edges: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracklets cut before the frames of points (tracklet, frame, new): the first part keeps the number and the links in, the
    second gets the new number and the links out, and a link joins them. Points outside a tracklet's life do nothing."""
    p = points.select("tracklet", F.col("frame").alias("__at"), F.col("new").alias("__new"))
    d = nodes.join(p, "tracklet", "left").withColumn("__cut", F.coalesce((F.col("__at") > F.col("fi")) & (F.col("__at") <= F.col("ff")), F.lit(False)))
    first = d.withColumn("ff", F.when(F.col("__cut"), F.col("__at") - 1).otherwise(F.col("ff")))
    second = d.where("__cut").withColumns({"tracklet": F.col("__new"), "fi": F.col("__at")})
    n = first.unionByName(second).drop("__at", "__new", "__cut")
    if "len" in n.columns:
        n = n.withColumn("len", F.col("ff") - F.col("fi") + 1)
    made = d.where("__cut").select(F.col("tracklet").alias("src"), F.col("__new").alias("dst"))
    e = edges.select("src", "dst").join(made.withColumnRenamed("dst", "__to"), "src", "left").select(F.coalesce("__to", "src").alias("src"), "dst")
    return n, e.union(made)


def clear_ids(state: DataFrame, tracklets: DataFrame) -> DataFrame:
    """The state of a solved graph without what is assigned to some tracklets; the ids stay possible."""
    t = tracklets.select("tracklet", F.lit(True).alias("__clear"))
    d = state.join(t, "tracklet", "left").withColumn("__clear", F.coalesce("__clear", F.lit(False)))
    return d.withColumns({"assigned": F.col("assigned") & ~F.col("__clear"), "score": F.when(~F.col("__clear"), F.col("score")), "finalized": F.col("finalized") & ~F.col("__clear")}).drop("__clear")


def node_flags(state: DataFrame, points: DataFrame) -> DataFrame:
    """points (tracklet, id) with possible and assigned; what the state does not hold is neither."""
    s = state.select("tracklet", "id", "possible", "assigned")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return points.join(s, ["tracklet", "id"], "left").select("tracklet", "id", no("possible"), no("assigned"))
