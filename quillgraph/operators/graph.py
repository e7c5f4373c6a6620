"""Graph operators over edge tables: components, merges, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each component, for the nodes of ``links``
    (x, y); loops and repeated links are fine, nodes without links aren't listed.

    Alternating stars (Kiveris et al., 2014): large stars tie a node's larger
    neighbours to its smallest one, small stars its smaller ones; both keep
    components whole and end in stars around the smallest nodes, in a number of
    rounds that grows with the logarithm of the longest path. A node's neighbours
    are never gathered: both steps are a minimum for each node and a join with it.
    Minima are written ahead of the joins, whose sides are then plain tables:
    a star's centre is one key of all its edges, and only such joins are dealt anew.
    State is a written table each round (a checkpoint's estimated size would double its
    digits with every join); only its count and checksum reach the driver.
    """
    edges = written(links.select("x", "y").where("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("y", "x"))
        least = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = written(large)
        smallest = written(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(smallest, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(smallest.select("x", F.col("m").alias("y")))
        edges = written(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct())
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("x", "y")), F.lit(0))).head()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(edges.select("y", "y")).distinct()


def degree(nodes: DataFrame, edges: DataFrame, node: str, edge_end: str) -> DataFrame:
    """Every node with its number of edges, zero included."""
    counts = edges.groupBy(F.col(edge_end).alias(node)).agg(F.count(F.lit(1)).alias("edges"))
    return nodes.select(node).join(counts, node, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def merge_clusters(pairs: DataFrame, degrees: DataFrame) -> DataFrame:
    """topic, root, canonical: each topic of a similarity component with the member
    that stays: of most edges, then the smallest name."""
    return chosen(components(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))), degrees)


def chosen(found: DataFrame, degrees: DataFrame) -> DataFrame:
    """``merge_clusters`` of components (node, root)."""
    placed = found.withColumnRenamed("node", "topic").join(degrees, "topic", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    best = placed.groupBy("root").agg(F.min(F.struct((-F.col("edges")).alias("e"), "topic")).alias("best")).select("root", F.col("best.topic").alias("canonical"))
    return placed.join(best, "root").select("topic", "root", "canonical")


def contract(edges: DataFrame, clusters: DataFrame, doc: str = "doc_id", topic: str = "topic") -> DataFrame:
    """Edges with merged topics redirected to the one that stays, each once."""
    mapping = clusters.select(F.col("topic").alias(topic), "canonical")
    return edges.join(mapping, topic, "left").select(doc, F.coalesce("canonical", topic).alias(topic)).distinct()


def without_merged(topics: DataFrame, clusters: DataFrame, topic: str = "topic") -> DataFrame:
    """Topics less those that another one stands for."""
    return topics.join(clusters.where("topic <> canonical").select(F.col("topic").alias(topic)), topic, "left_anti")


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str, *ends: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes ``gone`` and what touches them."""
    keys = gone.select(key).distinct()
    left = edges
    for end in ends:
        left = left.join(keys.withColumnRenamed(key, end), end, "left_anti")
    return nodes.join(keys, key, "left_anti"), left


def greedy_merge(pairs: DataFrame) -> DataFrame:
    """absorbed, keeper: rows in order of id; each that isn't absorbed yet absorbs the
    later ones similar to it. A star, not transitive.

    The order fixes the outcome, but not one row at a time: in each round every
    undecided row without an undecided earlier neighbour becomes a keeper, and its
    undecided later neighbours are absorbed. So there are as many rounds as the longest
    chain of rows each undecided because of the one before has keepers; state is a
    written table each round. Who absorbed a row is known at the end alone: an earlier
    neighbour may be undecided for longer than the row is, and turn out a keeper.
    """
    every = open_ = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    absorbed = None
    while not open_.isEmpty():
        keepers = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        taken = written(open_.join(keepers, "a").select(F.col("b").alias("a")).distinct())
        absorbed = taken if absorbed is None else absorbed.union(taken)
        gone = taken.union(keepers)
        open_ = open_.join(gone, "a", "left_anti")
        open_ = written(open_.join(gone.select(F.col("a").alias("b")), "b", "left_anti"))
    if absorbed is None:
        return pairs.sparkSession.createDataFrame([], "absorbed long, keeper long")
    return every.join(absorbed, "a", "left_anti").groupBy(F.col("b").alias("absorbed")).agg(F.min("a").alias("keeper"))


def louvain(edges: DataFrame, levels: int = 40, rounds: int = 100) -> DataFrame:
    """node, community: modularity communities (Blondel et al., 2008) of an undirected
    graph (x, y, w), in turns of simultaneous moves.

    In a turn a drawn part of the nodes, a half at first, each move to the
    neighbouring community of the greatest gain; the next turn is the other part's.
    A turn that doesn't raise modularity (neighbours that swap places, say) is taken
    back and drawn again in parts half as large, in the end one node, whose gain is
    certain. So modularity only rises, and a level ends when no node of either part
    has a move that gains; then communities become nodes, until none merge. Ties go
    to the smaller community; communities are named after their smallest node.
    Gains count to nine decimals of weight.

    Nodes of one neighbour are folded into it ahead of all that: in a partition of the
    greatest modularity a leaf is never apart from its neighbour (with it, it gains its
    link's weight less a product of two shares, of which its own is that weight). Of two
    that have only each other the larger is folded. So stars leave nothing to move.

    ``levels`` and ``rounds`` (of as many turns as there are parts, in a level) are
    bounds for safety: a graph that isn't settled there is an error. Iterations are
    joins and aggregations over edges, written each turn; what reaches the driver are
    counts and sums.
    """
    both = edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.col("w").cast("double").alias("w")).groupBy("x", "y").agg(F.sum("w").alias("w"))
    graph = written(both.union(both.select("y", "x", "w")))  # each link twice; a loop holds its weight twice
    total = graph.agg(F.coalesce(F.sum("w"), F.lit(0.0))).head()[0]
    if not total:
        return graph.select(F.col("x").alias("node")).distinct().withColumn("community", F.col("node"))
    leaves = written(folded(graph))
    placed = leaves.select(F.col("n").alias("node"), F.col("name").alias("community"))
    graph = written(renamed(graph, leaves))
    for level in range(levels + 1):
        state, moved_here = settle(graph, total, level, rounds)
        if not moved_here:
            break
        if level == levels:
            raise RuntimeError("louvain: communities still merge at the last level")
        names = written(state.groupBy("c").agg(F.min("n").alias("name")).join(state, "c").select("n", "name"))
        placed = written(placed.join(names, placed.community == names.n).select("node", F.col("name").alias("community")))
        graph = written(renamed(graph, names))
    names = placed.groupBy("community").agg(F.min("node").alias("name"))
    return placed.join(names, "community").select("node", F.col("name").alias("community"))


def renamed(graph: DataFrame, names: DataFrame) -> DataFrame:
    """The graph of the nodes that names (n, name) make of its nodes: links are summed,
    and those within a node become a loop."""
    ends = graph.join(names.select(F.col("n").alias("x"), F.col("name").alias("cx")), "x").join(names.select(F.col("n").alias("y"), F.col("name").alias("cy")), "y")
    return ends.groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("w").alias("w"))


def folded(graph: DataFrame) -> DataFrame:
    """n, name: a leaf's only neighbour, or the node itself."""
    nodes = written(graph.groupBy(F.col("x").alias("n")).agg(F.count(F.lit(1)).alias("links"), F.min("y").alias("next"), F.min("w").alias("w")))
    leaves = nodes.where("links = 1 and w > 0").select("n", "next")  # a link of no weight ties nothing
    both = leaves.join(leaves.select(F.col("n").alias("next"), F.lit(True).alias("pair")), "next", "left")
    to = both.where(F.col("pair").isNull() | (F.col("next") < F.col("n"))).select("n", F.col("next").alias("name"))
    return nodes.select("n").join(to, "n", "left").select("n", F.coalesce("name", "n").alias("name"))


def settle(graph: DataFrame, total: float, level: int, rounds: int) -> tuple[DataFrame, bool]:
    """(n, c) once no node of ``graph`` gains by a move, and whether any moved."""
    state = graph.groupBy(F.col("x").alias("n")).agg(F.sum("w").alias("k")).select("n", "k", F.col("n").alias("c"))
    wants = F.col("to") != F.col("at")
    held, height, parts, turn, spent, movers = None, 0.0, 2, 0, 0.0, 0
    while True:
        size = state.groupBy("c").agg(F.sum("k").alias("s"))
        near = graph.where("x <> y").join(state.select(F.col("n").alias("y"), "c"), "y").groupBy(F.col("x").alias("n"), "c").agg(F.sum("w").alias("kc"))
        own = state.select("n", "c", F.lit(0.0).alias("kc"))
        options = near.unionByName(own).groupBy("n", "c").agg(F.sum("kc").alias("kc")).join(size, "c").join(state.select("n", "k", F.col("c").alias("at")), "n")
        here = F.col("c") == F.col("at")
        gain = F.col("kc") - F.col("k") * (F.col("s") - F.when(here, F.col("k")).otherwise(0.0)) / total
        share = F.when(here, F.col("kc") - F.col("k") * F.col("s") / total)  # of modularity, less loops, which stay
        best = options.select("n", "k", "at", "c", F.round(gain, 9).alias("g"), share.alias("q")).groupBy("n", "k", "at").agg(F.max(F.struct("g", (F.col("c") == F.col("at")).alias("stay"), (-F.col("c")).alias("less"))).alias("b"), F.max("q").alias("q"))
        best = written(best.select("n", "k", "at", (-F.col("b.less")).alias("to"), "q"))
        now, left = best.agg(F.sum("q"), F.count_if(wants)).head()
        if held is None or movers == 1 or now > height:
            moved = held is not None
            held, height, parts = best, now, max(2, parts // 2)
            if not left:
                return held.select("n", F.col("at").alias("c")), moved
        else:
            parts *= 2
        if spent >= rounds:
            raise RuntimeError("louvain: nodes still move at the last round")
        drawn = F.pmod(F.xxhash64("n", F.lit(level), F.lit(turn // parts)) - turn, F.lit(parts))
        part, movers = held.where(wants).groupBy(drawn.alias("part")).count().orderBy("part").head()  # the next with a move
        state = held.select("n", "k", F.when(wants & (drawn == part), F.col("to")).otherwise(F.col("at")).alias("c"))
        turn += 1
        spent += 1 / parts


def modularity(edges: DataFrame, placed: DataFrame) -> float:
    both = edges.where("x <> y").select("x", "y", F.col("w").cast("double").alias("w"))
    both = both.union(both.select("y", "x", "w"))
    found = both.join(placed.select(F.col("node").alias("x"), F.col("community").alias("cx")), "x").join(placed.select(F.col("node").alias("y"), F.col("community").alias("cy")), "y")
    inside = found.groupBy().agg(F.sum("w").alias("total"), F.sum(F.when(F.col("cx") == F.col("cy"), F.col("w")).otherwise(0.0)).alias("inner")).head()
    if not inside.total:
        return 0.0
    squares = found.groupBy("cx").agg(F.sum("w").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).head()[0]
    return inside.inner / inside.total - squares / inside.total**2


def first_of_each(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """key, values: the first ``most`` values of each key, in order; nulls don't count.
    Only those are gathered: tasks keep no more of a key than that."""
    ranked = rows.where(F.col(value).isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("n") <= most)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def community_members(doc_communities: DataFrame, topic_communities: DataFrame, topics: int = 20, titles: int = 10) -> DataFrame:
    """community, topics, titles: the first members of each, in order; nulls don't count."""
    names = first_of_each(topic_communities, "community", "topic", topics).withColumnRenamed("values", "topics")
    heads = first_of_each(doc_communities, "community", "title", titles).withColumnRenamed("values", "titles")
    empty = F.array().cast("array<string>")
    return names.join(heads, "community", "full").select("community", F.coalesce("topics", empty).alias("topics"), F.coalesce("titles", empty).alias("titles"))


def belongs_to(docs: DataFrame, topics: DataFrame, communities: DataFrame) -> DataFrame:
    """kind, key, community for every node with the id of a known community."""
    every = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("key"), "community").union(topics.select(F.lit("topic"), F.col("topic").cast("string"), "community"))
    return every.join(communities.select("community").distinct(), "community", "left_semi").select("kind", "key", "community")
