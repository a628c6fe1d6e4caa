"""Communities of a graph by modularity, in rounds over tables.

Every node begins as a community of its own. In a round each node looks at the communities around it and moves to the one
that raises the modularity most; half of the nodes may move in a round, by a hash, so that neighbours don't change places for
ever. When no node moves, communities become the nodes of a smaller graph, whose weights are sums, and so on until nothing
merges. Communities are then refined: what is not connected inside is parted. With a greatest size, larger communities are
graphs of their own and are parted in the same way, all at once; one that modularity keeps whole (a star, a clique) is dealt
out by a hash and its pieces are refined.

Nodes, labels and weights stay in tables; a round's labels are written to the shared folder, and only the number of moves
reaches the driver. Parallel edges count once and edges from a node to itself don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import connected
from brindle.session import dropped, stored

GAIN = 1e-9  # a move has to raise the modularity by this at least, times the graph's weight
ROUNDS, LEVELS, PASSES = 60, 20, 3
SHARES = 3  # of the nodes, one of which may move in a round
FILL = 0.8  # share of the greatest size that a dealt piece has on average


def simple_links(edges: DataFrame) -> DataFrame:
    """(src, dst, w): each pair of different nodes that an edge joins, both ways, with weight 1."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    both = e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return both.withColumn("w", F.lit(1.0))


def modularity(links: DataFrame, label: DataFrame) -> float:
    """Of a labelling (node, label) of a graph (src, dst, w both ways)."""
    k = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).join(label, "node")
    tot = k.groupBy("label").agg(F.sum("k").alias("tot"))
    whole = links.agg(F.sum("w")).first()[0]
    if not whole:
        return 0.0
    one, two = (label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst"))
    inside = links.join(one, "src").join(two, "dst").filter("src_label = dst_label").agg(F.sum("w")).first()[0] or 0.0
    return inside / whole - tot.agg(F.sum(F.col("tot") * F.col("tot"))).first()[0] / whole**2


def _moves(links: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """label (part, node, label, k, whole) after a round, with `moved`. links: part, src, dst, w."""
    tot = label.groupBy("part", "label").agg(F.sum("k").alias("tot"))
    there = label.select("part", F.col("node").alias("dst"), "label")
    near = links.filter("src <> dst").join(there, ["part", "dst"]).groupBy("part", F.col("src").alias("node"), "label").agg(F.sum("w").alias("near"))
    own = label.select("part", "node", F.col("label").alias("own"), "k", "whole")
    stay = label.select("part", "node", "label", F.lit(0.0).alias("near"))
    options = near.unionByName(stay).groupBy("part", "node", "label").agg(F.sum("near").alias("near"))
    d = options.join(tot, ["part", "label"]).join(own, ["part", "node"])
    at_home = F.col("label") == F.col("own")
    gain = F.col("near") - F.col("k") * (F.col("tot") - F.when(at_home, F.col("k")).otherwise(0.0)) / F.col("whole")
    d = d.withColumn("gain", F.round(gain, 9))
    best = d.groupBy("part", "node").agg(F.min(F.struct((-F.col("gain")).alias("g"), "label")).alias("best"), F.max(F.when(at_home, F.col("gain"))).alias("stays"), F.first("own").alias("own"), F.first("k").alias("k"), F.first("whole").alias("whole"))
    may = F.pmod(F.xxhash64("part", "node", F.lit(turn // SHARES)) + turn, F.lit(SHARES)) == 0
    best = best.withColumn("goes", may & (-F.col("best.g") > F.col("stays") + GAIN * F.col("whole")))
    # Of those that go to one community each counts the weight of those before it, so all of them together raise the modularity too.
    before = Window.partitionBy("part", "best.label", "goes").orderBy("best.g", "node").rowsBetween(Window.unboundedPreceding, -1)
    joined = F.coalesce(F.sum("k").over(before), F.lit(0.0))
    best = best.withColumn("joined", joined)
    goes = F.col("goes") & (-F.col("best.g") - F.col("k") * F.col("joined") / F.col("whole") > F.col("stays") + GAIN * F.col("whole"))
    return best.select("part", "node", F.when(goes, F.col("best.label")).otherwise(F.col("own")).alias("label"), "k", "whole", goes.alias("moved"))


def _moved(links: DataFrame, start: DataFrame) -> tuple[DataFrame, int]:
    """(labels after rounds until no node of any share moves, number of moves)."""
    label, quiet, moves = start, 0, 0
    for turn in range(ROUNDS):
        following = stored(_moves(links, label, turn))
        n = following.filter("moved").count()
        dropped(label)
        label, moves = following, moves + n
        quiet = 0 if n else quiet + 1
        if quiet == SHARES:
            break
    return label, moves


def refined(links: DataFrame, label: DataFrame) -> DataFrame:
    """(part, node, label): the connected pieces of each label; a piece is named by its least node. links: part, src, dst."""
    one, two = (label.select("part", F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst"))
    inside = links.filter("src <> dst").join(one, ["part", "src"]).join(two, ["part", "dst"]).filter("src_label = dst_label").select("src", "dst")
    pieces = connected(inside)
    return label.select("part", "node").join(pieces, "node", "left").select("part", "node", F.coalesce("component", "node").alias("label"))


def _merged_links(links: DataFrame, label: DataFrame) -> DataFrame:
    """The graph whose nodes are the labels: weights between two are summed, those inside one are its link to itself."""
    one, two = (label.select("part", F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst"))
    both = links.join(one, ["part", "src"]).join(two, ["part", "dst"])
    return both.groupBy("part", F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).agg(F.sum("w").alias("w"))


def _nodes_of(links: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(part, node, label, k, whole): the nodes of a graph with their weights and those of their parts; alone, or with labels."""
    k = links.groupBy("part", F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    k = k.join(links.groupBy("part").agg(F.sum("w").alias("whole")), "part")
    k = k.withColumn("label", F.col("node")) if label is None else k.join(label.select("part", "node", "label"), ["part", "node"])
    return k.select("part", "node", "label", "k", "whole")


def by_modularity(links: DataFrame) -> DataFrame:
    """(part, node, label): communities of each part of a graph (part, src, dst, w), which has no links between parts.

    Nodes move, the graph of their communities is taken, its nodes move, and so on; then the nodes of the first graph may move
    once more from where that has brought them, and all begins again from there if any does."""
    links = stored(links)
    label = None
    for turn in range(PASSES):
        label, moves = _moved(links, stored(_nodes_of(links, label)))
        if turn and not moves:
            break
        named, here = stored(label.select("part", "node", "label")), links
        for _ in range(LEVELS):
            up = stored(_merged_links(here, named if here is links else at))
            if here is not links:
                dropped(here)
            here = up
            at, moves = _moved(here, stored(_nodes_of(here)))
            if not moves:
                break
            to = at.select("part", F.col("node").alias("label"), F.col("label").alias("to"))
            following = stored(named.join(to, ["part", "label"]).select("part", "node", F.col("to").alias("label")))
            dropped(named)
            named = following
        dropped(label, here, at)
        label = named
    return refined(links, label)


def communities_within(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, label) of the nodes of edges (src, dst) that have a link: connected communities of at most `most` nodes, named
    by their least node."""
    links = stored(simple_links(edges).withColumn("part", F.lit("")))
    label = stored(by_modularity(links))
    if most is None:
        return label.select("node", "label")
    while True:
        sizes = label.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        large = stored(label.join(sizes, "label").select(F.col("label").alias("part"), "node", "n"))
        if large.isEmpty():
            return label.select("node", "label")
        one, two = (large.select("part", F.col("node").alias(c)) for c in ("src", "dst"))
        inner = stored(links.drop("part").join(one, "src").join(two.withColumnRenamed("part", "other"), "dst").filter("part = other").select("part", "src", "dst", "w"))
        parted = stored(by_modularity(inner))
        # One that is whole still is dealt out, in pieces that are mostly small enough.
        still = parted.groupBy("part").agg(F.countDistinct("label").alias("pieces")).filter("pieces = 1").select("part")
        dealt = large.join(still, "part").select("part", "node", F.pmod(F.xxhash64("node", F.col("n")), F.ceil(F.col("n") / (FILL * most))).cast("string").alias("label"))
        parted = parted.join(still, "part", "left_anti").unionByName(refined(inner, dealt))
        following = stored(label.join(large.select("node"), "node", "left_anti").select("node", "label").unionByName(parted.select("node", "label")))
        dropped(label, large)
        label = following
