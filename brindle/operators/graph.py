"""Property graphs as edge tables: merging, expansion, ranking, components and entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.relational import same_entity_candidate
from brindle.session import dropped, stored


def merged_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of triples (project_id, file_id, seq, subject, relation, object, s_type, o_type): type and file of an
    edge are those of its first triple, files are collected without repeats."""
    ends = triples.select("project_id", "file_id", "seq", F.col("subject").alias("name"), F.col("s_type").alias("type")).unionByName(
        triples.select("project_id", "file_id", "seq", F.col("object").alias("name"), F.col("o_type").alias("type"))
    )
    vertices = ends.groupBy("project_id", "name").agg(F.min(F.struct("seq", "type"))["type"].alias("type"), F.array_sort(F.collect_set("file_id")).alias("file_ids"))
    edges = triples.groupBy("project_id", F.col("subject").alias("src"), "relation", F.col("object").alias("dst")).agg(F.min(F.struct("seq", "file_id"))["file_id"].alias("file_id"))
    return vertices, edges


def both_ways(edges: DataFrame) -> DataFrame:
    """(edge_id, src, dst, relation) in both directions; edge_id names the undirected edge."""
    e = edges.select(F.xxhash64("src", "relation", "dst").alias("edge_id"), "src", "dst", "relation")
    return e.unionByName(e.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))


EDGES_TOGETHER = 1024  # of one node; a node of more has them in parts, and a path meets each part elsewhere


def all_paths(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """(seed, node, distance, nodes, relations, path): all paths of up to most steps from seeds, no edge used twice; path as rendered.

    There are as many rows as paths, but only those that can go on (the last node has another edge than that they came by) are kept and
    shuffled for the next step; the others are made where the result is written. No table is sent to all tasks, and
    the edges of a node of many lie in parts of about EDGES_TOGETHER that are joined in different tasks."""
    e = both_ways(edges)
    nodes = e.groupBy("src").agg(F.min("edge_id").alias("lo"), F.max("edge_id").alias("hi"), F.ceil(F.count("*") / EDGES_TOGETHER).cast("int").alias("parts"))
    nodes = stored(nodes)
    at = lambda column: nodes.select(F.col("src").alias(column), "lo", "hi", "parts").hint("merge")
    arcs = e.join(at("src"), "src").withColumn("part", F.pmod(F.xxhash64("edge_id", "dst"), F.col("parts")).cast("int")).drop("lo", "hi", "parts")
    on = F.when((F.col("lo") != F.col("edge_id")) | (F.col("hi") != F.col("edge_id")), F.col("parts")).alias("parts")
    arcs = stored(arcs.join(at("dst"), "dst", "left").select("edge_id", "src", "dst", "relation", "part", on))
    path = seeds.select("seed", F.col("seed").alias("node")).join(at("node").select("node", "parts"), "node")
    path = path.select("seed", "node", F.lit(0).alias("distance"), F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<bigint>").alias("used"), F.col("seed").alias("path"), "parts")

    def extended(by: DataFrame) -> DataFrame:
        p = path.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        step = p.alias("p").join(by.hint("merge").alias("e"), (F.col("p.node") == F.col("e.src")) & (F.col("p.part") == F.col("e.part"))).filter(~F.array_contains("p.used", F.col("e.edge_id")))
        said = F.coalesce(F.concat(F.lit("（"), "e.relation", F.lit("）"), "e.dst"), F.lit(""))
        return step.select(
            "p.seed", F.col("e.dst").alias("node"), (F.col("p.distance") + 1).alias("distance"), F.concat("p.nodes", F.array("e.dst")).alias("nodes"),
            F.concat("p.relations", F.array("e.relation")).alias("relations"), F.concat("p.used", F.array("e.edge_id")).alias("used"), F.concat("p.path", said).alias("path"), "e.parts",
        )

    out = None
    for k in range(1, most + 1):
        found = extended(arcs).drop("used", "parts")
        out = found if out is None else out.unionByName(found)
        if k < most:
            path = stored(extended(arcs.filter("parts is not null")))
    return out


def hops(edges: DataFrame, seeds: DataFrame, most: int = 2, most_paths: int | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """(seed, node, distance, nodes, relations): paths from seeds, no edge used twice. One join for each step.

    With most_paths only a seed's first paths are found, nearest first, then by name: a seed goes on only while it lacks some,
    from no more paths than it lacks. With ranks (node, pagerank) too, a seed's first ones are those that end at the highest ranks,
    as ranked_paths finds them."""
    if ranks is not None:
        return ranked_paths(edges, seeds, ranks, most, most_paths or 1 << 30)
    if most_paths is None:
        return all_paths(edges, seeds, most).drop("path")
    e = both_ways(edges)
    path = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance"), F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<bigint>").alias("used"), F.lit(0).alias("before"))
    first = Window.partitionBy("seed").orderBy("nodes", "relations")
    out = None
    for _ in range(most):
        step = path.alias("p").join(e.alias("e"), F.col("p.node") == F.col("e.src")).filter(~F.array_contains("p.used", F.col("e.edge_id")))
        path = step.select(
            "p.seed", F.col("e.dst").alias("node"), (F.col("p.distance") + 1).alias("distance"), F.concat("p.nodes", F.array("e.dst")).alias("nodes"),
            F.concat("p.relations", F.array("e.relation")).alias("relations"), F.concat("p.used", F.array("e.edge_id")).alias("used"), "p.before",
        )
        # Paths of one step have one length: what is kept of them is what a longer one could follow.
        path = path.withColumn("r", F.row_number().over(first)).filter(F.col("r") + F.col("before") <= most_paths)
        path = path.withColumn("before", F.col("before") + F.count("*").over(Window.partitionBy("seed"))).drop("r")
        found = path.drop("before", "used")
        out = found if out is None else out.unionByName(found)
        path = path.filter(F.col("before") < most_paths)
    return out


def arcs_ahead(edges: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """(edge_id, src, dst, relation, neg, ahead1 .. ahead<most>): each direction of each edge with the rank of its end (negated, infinite
    if it has none), and with the best that a walk of up to so many steps more can end at: (negated rank, steps), null if there is
    no step. A walk does not turn back on the edge it came by, so a node hands on its two best edges; a path, which uses no edge
    twice, ends at no better rank."""
    a = both_ways(edges).join(ranks.select(F.col("node").alias("dst"), F.col("pagerank").cast("double").alias("rank")), "dst", "left")
    a = a.select("edge_id", "src", "dst", "relation", F.coalesce(-F.col("rank"), F.lit(float("inf"))).alias("neg"))
    here = F.struct("neg", F.lit(1).alias("steps"))
    two = Window.partitionBy("src").orderBy("w", "edge_id")
    for k in range(1, most + 1):
        on = here if k == 1 else F.least(here, F.when(F.col(f"ahead{k - 1}").isNotNull(), F.struct(F.col(f"ahead{k - 1}.neg").alias("neg"), (F.col(f"ahead{k - 1}.steps") + 1).alias("steps"))))
        best = a.groupBy("src", "edge_id").agg(F.min(on).alias("w")).withColumn("r", F.row_number().over(two)).filter("r <= 2")
        best = best.groupBy(F.col("src").alias("at")).agg(F.min(F.struct("w", "edge_id")).alias("one"), F.max(F.struct("w", "edge_id")).alias("two"))
        a = a.join(best.hint("merge"), F.col("dst") == F.col("at"), "left")
        a = a.withColumn(f"ahead{k}", F.when(F.col("one.edge_id") != F.col("edge_id"), F.col("one.w")).when(F.col("two.edge_id") != F.col("edge_id"), F.col("two.w"))).drop("at", "one", "two")
    return a


def ranked_paths(edges: DataFrame, seeds: DataFrame, ranks: DataFrame, most: int = 3, most_paths: int = 30) -> DataFrame:
    """(node, seed, distance, nodes, relations, pagerank, rank0): of a seed's paths of up to most steps, no edge used twice, the
    first most_paths by the rank of their end, then distance, nodes and relations.

    Best first: a path's bound is the best end that it can still reach (arcs_ahead), and of each step only a seed's most_paths
    paths of the best bounds go on. That bound is met unless a walk needs an edge twice; what was left behind with a better bound than
    the last path kept therefore goes on afterwards. A node's edges are put in order once, by their ends and by their bounds. Of one path
    only the first of them, as many as are kept and those that it may have used, can be among a seed's first, so no step makes a row
    for each edge of a node of many; behind those, edges lie in bands of twice as many each, and a path that was left behind
    is joined only with bands of which the best edge is good enough.

    Defined cases: nodes without a rank come last; a seed without edges, null seeds and empty tables give no rows; repeated edges give
    repeated paths; ranks are finite."""
    from brindle.operators.search import top_k

    arcs = arcs_ahead(edges, ranks, most - 1)
    if most_paths < 1 << 30:  # more copies of an edge than paths are kept change nothing
        arcs = arcs.withColumn("copy", F.row_number().over(Window.partitionBy("src", "edge_id", "dst").orderBy("neg"))).filter(F.col("copy") <= most_paths).drop("copy")
    arcs = stored(arcs)
    order = [F.col("neg"), F.col("distance"), F.col("nodes"), F.col("relations")]
    kept = ["seed", "node", "distance", "nodes", "relations", "neg"]
    enough = min(most_paths + most, 1 << 30)

    def placed(of: DataFrame, *by: str) -> DataFrame:
        return of.withColumn("place", F.dense_rank().over(Window.partitionBy("src").orderBy(*by, "dst", "relation", "edge_id")))

    last_edges = stored(placed(arcs.select("edge_id", "src", "dst", "relation", "neg"), "neg").filter(F.col("place") <= enough).drop("place"))
    onward, bands = {}, {}
    for left in range(1, most):
        on = placed(arcs.filter(f"ahead{left} is not null").select("edge_id", "src", "dst", "relation", "neg", F.col(f"ahead{left}").alias("ahead")), "ahead")
        band = F.when(F.col("place") <= enough, 0).otherwise(F.floor(F.log2((F.col("place") - 1) / enough)) + 1).cast("int")
        onward[left] = stored(on.withColumn("band", band).drop("place"))
        bands[left] = onward[left].groupBy("src", "band").agg(F.min(F.struct("ahead", "dst")).alias("top"))

    def extended(path: DataFrame, by: DataFrame, *more: str) -> DataFrame:
        """Paths with one edge more, of those that by has for their node (and band)."""
        on = (F.col("p.node") == F.col("e.src")) & ((F.col("p.band") == F.col("e.band")) if "band" in path.columns else F.lit(True))
        step = path.alias("p").join(by.hint("merge").alias("e"), on).filter(~F.array_contains("p.used", F.col("e.edge_id")))
        bound = F.struct("e.ahead.neg", (F.col("p.distance") + 1 + F.col("e.ahead.steps")).alias("distance")).alias("bound")
        return step.select(
            "p.seed", F.col("e.dst").alias("node"), (F.col("p.distance") + 1).alias("distance"), F.concat("p.nodes", F.array("e.dst")).alias("nodes"),
            F.concat("p.relations", F.array("e.relation")).alias("relations"), F.concat("p.used", F.array("e.edge_id")).alias("used"), "e.neg", *[bound] * ("ahead" in by.columns), *more,
        )

    def best(paths: DataFrame) -> DataFrame:
        return top_k(paths.select(*kept), "seed", most_paths, *order).drop("rank0")

    path = seeds.filter("seed is not null").select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance"), F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<bigint>").alias("used"))
    paths, found = [path], None
    by_bound = Window.partitionBy("seed").orderBy("bound", "nodes", "relations")
    for k in range(1, most + 1):
        step = best(extended(paths[-1], last_edges))
        found = stored(step if found is None else best(step.unionByName(found)))
        if k < most:
            gone = extended(paths[-1], onward[most - k].filter("band = 0")).withColumn("r", F.rank().over(by_bound)).filter(F.col("r") <= most_paths)
            paths.append(stored(gone.drop("r")))
    # A seed's last path is the floor; without most_paths of them nothing was left behind.
    last = top_k(found, "seed", most_paths, *order).filter(F.col("rank0") == most_paths - 1)
    floor = stored(last.select("seed", F.struct("neg", "distance").alias("floor"), F.col("nodes").alias("floor_nodes")))

    def hopeful(bound: Column, nodes: Column) -> Column:
        return (bound < F.col("floor")) | ((bound == F.col("floor")) & (nodes <= F.slice("floor_nodes", F.lit(1), F.size(nodes))))

    def left_behind(path: DataFrame, left: int, gone: DataFrame | None) -> DataFrame:
        """Paths with one edge more that may end before the floor, of those behind the last that has gone on, if any has."""
        d = path.drop("bound", "neg").join(floor.hint("merge"), "seed")
        if gone is not None:
            d = d.join(gone.groupBy("seed").agg(F.max(F.struct("bound", "nodes", "relations")).alias("gone"), F.count("*").alias("n")).filter(F.col("n") >= most_paths).drop("n"), "seed")
        b = d.alias("d").join(bands[left].hint("merge").alias("b"), F.col("d.node") == F.col("b.src"))
        top = F.struct("top.ahead.neg", (F.col("distance") + 1 + F.col("top.ahead.steps")).alias("distance"))
        b = b.filter(hopeful(top, F.concat("nodes", F.array("top.dst")))).drop("src", "top")
        x = extended(b, onward[left], "floor", "floor_nodes", *["gone"] * (gone is not None)).filter(hopeful(F.col("bound"), F.col("nodes")))
        return (x if gone is None else x.filter(F.struct("bound", "nodes", "relations") > F.col("gone"))).drop("floor", "floor_nodes", "gone")

    late, more = None, found
    for k in range(1, most):
        behind = left_behind(paths[k - 1], most - k, paths[k])
        late = stored(behind if late is None else behind.unionByName(left_behind(late, most - k, None)))
        more = more.unionByName(extended(late, last_edges).select(*kept))
    out = best(more).withColumn("pagerank", F.when(F.col("neg") != float("inf"), -F.col("neg")))
    return top_k(out.select("node", "seed", "distance", "nodes", "relations", "pagerank"), "seed", most_paths, F.desc_nulls_last("pagerank"), F.asc("distance"), F.asc("nodes"), F.asc("relations"))


def rendered(nodes: Column, relations: Column) -> Column:
    """A path as text: A（r）B（s）C."""
    tail = F.zip_with(relations, F.slice(nodes, 2, 1 << 30), lambda r, n: F.concat(F.lit("（"), r, F.lit("）"), n))
    return F.concat(F.get(nodes, F.lit(0)), F.array_join(tail, ""))


def pagerank(edges: DataFrame, tolerance: float = 1e-6, damping: float = 0.85, save_each: int = 5, most_rounds: int = 500) -> DataFrame:
    """(node, pagerank) of the undirected simple graph, by rounds of joins until a round changes the ranks by less than tolerance a
    node on average; parallel edges count once. RuntimeError if that takes more than most_rounds."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    e = e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    degree = e.groupBy("src").agg(F.count("*").alias("degree"))
    links = stored(e.join(degree, "src"))
    nodes = stored(degree.select(F.col("src").alias("node")))
    n = nodes.count()
    rank = nodes.withColumn("pagerank", F.lit(1.0 / max(1, n)))
    rounds, changed, last = 0, n > 0, None
    while changed:
        if rounds >= most_rounds:
            raise RuntimeError(f"ranks still change after {rounds} rounds")
        for _ in range(save_each):
            before = rank
            flow = links.join(rank, links.src == rank.node).groupBy("dst").agg(F.sum(F.col("pagerank") / F.col("degree")).alias("in"))
            rank = flow.select(F.col("dst").alias("node"), (F.lit((1 - damping) / n) + damping * F.col("in")).alias("pagerank"))
        both = stored(rank.join(before.withColumnRenamed("pagerank", "was"), "node"))
        dropped(last)
        last = both
        changed = both.agg(F.sum(F.abs(F.col("pagerank") - F.col("was")))).first()[0] >= n * tolerance
        rank, rounds = both.select("node", "pagerank"), rounds + save_each
    return rank.withColumn("pagerank", F.round("pagerank", 6))


def connected(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component): the least name that a node reaches. Each round hands labels on and jumps to the label's own label;
    RuntimeError if labels still change after most_rounds."""
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = stored(e)
    label = e.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component"))
    label, before = stored(label), None
    for _ in range(most_rounds):
        near = e.join(label, e.dst == label.node).groupBy("src").agg(F.min("component").alias("m"))
        following = label.join(near, label.node == near.src, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = following.select(F.col("node").alias("c"), F.col("c").alias("jumped"))
        jumped = stored(following.join(jump, "c", "left").select("node", F.coalesce("jumped", "c").alias("component")))
        dropped(label)
        label = jumped
        state = label.agg(F.sum(F.xxhash64("node", "component") % 1_000_003)).first()[0]
        if state == before:
            return label
        before = state
    raise RuntimeError(f"components still change after {most_rounds} rounds")


COMMUNITY_SIZE, COMMUNITY_LEAST, GRAPH_LEAST = 15, 3, 5


def communities(edges: DataFrame, least: int = COMMUNITY_LEAST, project: str = "p", most: int | None = None, graph_least: int = GRAPH_LEAST) -> DataFrame:
    """(community_id, members) of graphs of enough nodes: connected components with enough members, or, with most, communities by
    modularity of at most so many, connected each; the id is a hash of the sorted names."""
    from brindle.functions.identity import community_id
    from brindle.operators.communities import communities_within

    part = connected(edges) if most is None else communities_within(edges, most).withColumnRenamed("label", "component")
    size = part.agg(F.count("*").alias("nodes"))
    g = part.groupBy("component").agg(F.array_sort(F.collect_set(F.col("node").cast("string"))).alias("members"))
    g = g.join(F.broadcast(size)).filter((F.size("members") >= least) & (F.col("nodes") >= graph_least))  # a single number
    return g.select(community_id(F.lit(project), F.col("members")).alias("community_id"), "members")


def community_changes(now: DataFrame, stored: DataFrame, key: str = "community_id") -> DataFrame:
    """(key, change): new and obsolete communities."""
    new = now.select(key).join(stored, key, "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(stored.select(key).join(now, key, "left_anti").withColumn("change", F.lit("obsolete")))


def resolved_entities(vertices: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, vertices, edges) with confirmed pairs (a, b) merged: the shortest name of a component stays (then the least),
    the others become aliases, edges are pointed to it and repeats go."""
    part = connected(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    stays = part.groupBy("component").agg(F.min(F.struct(F.length("node").alias("n"), "node"))["node"].alias("canonical"))
    names = part.join(stays, "component").select(F.col("node").alias("name"), "canonical")
    v = vertices.join(names, "name", "left").withColumn("canonical", F.coalesce("canonical", "name"))
    v = v.groupBy(F.col("canonical").alias("key")).agg(F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name")))).alias("aliases"))
    to = lambda side: names.select(F.col("name").alias(side), F.col("canonical").alias(f"new_{side}"))
    e = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    e = e.select(F.coalesce("new_src", "src").alias("src"), "relation", F.coalesce("new_dst", "dst").alias("dst")).filter("src <> dst").distinct()
    return names, v.withColumnRenamed("key", "name"), e


def candidate_pairs(names: DataFrame, block: str = "type") -> DataFrame:
    """(block, a, b) of names of one type that may mean one thing. Names meet on a shared pair of characters, not all with all, and
    only if their pairs with a digit are the same, as no candidates differ in one; pairs of characters that many names hold
    are dealt over several tasks."""
    from brindle.operators.relational import pairs_of, salted_join

    digits = F.array_sort(F.filter(pairs_of(F.col("name")), lambda g: g.rlike("[0-9]")))
    n = names.select(block, "name").distinct()
    g = n.select(F.col(block), "name", F.explode(pairs_of(F.lower("name"))).alias("g"), digits.alias("d")).withColumn("at", F.xxhash64(block, "g", "d"))
    met = salted_join(g.select(block, "g", "at", "d", F.col("name").alias("a")), g.select(F.col("at"), F.col(block).alias("__block"), F.col("g").alias("__g"), F.col("d").alias("__d"), F.col("name").alias("b")), "at", "a")
    same = F.col(block).eqNullSafe(F.col("__block")) & (F.col("g") == F.col("__g")) & (F.col("d") == F.col("__d"))
    met = met.filter((F.col("a") < F.col("b")) & same).select(block, "a", "b").distinct()
    return met.filter(same_entity_candidate(F.col("a"), F.col("b")))


def sampled_edges(edges: DataFrame, most: int = 150) -> DataFrame:
    """The first edges of a graph, in order of their ends and relation, for a picture of it."""
    return edges.select("src", "relation", "dst").orderBy("src", "relation", "dst").limit(most)


def communities_of(triples: DataFrame, entities: DataFrame, members: DataFrame) -> DataFrame:
    """(src, relation, dst, s_type, o_type, community_id): triples with the types of their ends, where known, and the communities that
    hold the subject; triples of no community stay, without one."""
    kind = lambda side, name: entities.select(F.col("name").alias(side), F.col("type").alias(name))
    d = triples.select("src", "relation", "dst").join(kind("src", "s_type"), "src", "left").join(kind("dst", "o_type"), "dst", "left")
    d = d.join(members.select("community_id", F.col("node").alias("src")), "src", "left")
    return d.select("src", "relation", "dst", "s_type", "o_type", "community_id")


def entities_holding(entities: DataFrame, words: DataFrame, name: str = "name") -> DataFrame:
    """(word, name): entities whose name holds a word. A word is looked for where its rarest pair of characters occurs (of a word of one
    character, that); no word meets all names. Empty words are in no name. Pairs that no word has are left out as names are cut, and
    names with their pairs are never sent to all tasks, however small Spark takes them to be."""
    from brindle.operators.search import small

    cut = lambda t, n: F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: t.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    w = words.select("word").filter("word <> ''").distinct()
    grams = stored(w.select("word", F.explode(F.when(F.length("word") == 1, F.array("word")).otherwise(cut(F.col("word"), 2))).alias("gram")))
    of_names = entities.select(F.col(name), F.explode(F.concat(cut(F.col(name), 1), cut(F.col(name), 2))).alias("gram"))
    frequency = of_names.join(small(grams.select("gram").distinct(), part_of=grams), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = stored(grams.join(frequency, "gram").groupBy("word").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")))
    met = of_names.join(small(rarest.select("word", "gram"), part_of=rarest), "gram")
    return met.filter(F.col(name).contains(F.col("word"))).select("word", name)


def without_file(edges: DataFrame, vertices: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) without the edges of some files (file_id) and the vertices that no edge holds any more."""
    e = edges.join(gone.select("file_id"), "file_id", "left_anti")
    ends = e.select(F.col("src").alias("name")).unionByName(e.select(F.col("dst").alias("name"))).distinct()
    return e, vertices.join(ends, "name", "left_semi")


def statistics(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, n_seen): nodes, edges, and edges as a match without direction sees them, twice each."""
    ends = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n")))
    return ends.agg(F.countDistinct("n").alias("n_nodes")).join(edges.agg(F.count("*").alias("n_edges"), (F.count("*") * 2).alias("n_seen")))


def inner_edges(edges: DataFrame, members: DataFrame, most: int | None = None) -> DataFrame:
    """(community_id, src, relation, dst) of edges with both ends in one community (members: community_id, node); with most, the
    first so many of each, in their order, as the context of a summary takes them."""
    a = edges.join(members.select("community_id", F.col("node").alias("src")), "src")
    found = a.join(members.select("community_id", F.col("node").alias("dst")), ["community_id", "dst"]).select("community_id", "src", "relation", "dst")
    if most is None:
        return found
    order = Window.partitionBy("community_id").orderBy("src", "relation", "dst")
    return found.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).drop("__r")


def document_tree(chunks: DataFrame, fields: Column) -> DataFrame:
    """(src, relation, dst): documents to their elements, and form fields to the elements that give evidence of them.
    chunks: doc_id, chunk_index, document."""
    element = F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_index").cast("string"))
    d = chunks.withColumn("element", element)
    has = d.select(F.col("doc_id").cast("string").alias("src"), F.lit("HAS_ELEMENT").alias("relation"), F.col("element").alias("dst"))
    return has.unionByName(d.select(F.explode(fields).alias("src"), F.lit("EVIDENCE_BY").alias("relation"), F.col("element").alias("dst")))


def subgraph(edges: DataFrame, seeds: DataFrame, ranks: DataFrame, most_paths: int = 30) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) around seeds within two steps: entities by falling rank and name, relations by their ends."""
    paths = hops(edges, seeds, 2, most_paths)
    entities = paths.select(F.explode("nodes").alias("node")).distinct().join(ranks, "node", "left").orderBy(F.desc_nulls_last("pagerank"), "node")
    near = entities.select("node")
    e = edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return entities, e.select("src", "relation", "dst").distinct().orderBy("src", "relation", "dst")


def pending(communities: DataFrame, summaries: DataFrame, page: int = 5) -> tuple[DataFrame, bool]:
    """(the next communities without a summary, are there more): one more is looked at than is given."""
    left = communities.join(summaries.select("community_id"), "community_id", "left_anti").orderBy("community_id").limit(page + 1)
    return left.limit(page), left.count() > page
