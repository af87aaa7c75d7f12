"""A property graph in two frames: nodes (id, label, code) and edges (src, dst, rel_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.plans.session import cut


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node, relation), name and n: nodes per label and relations per type."""
    a = nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return a.unionByName(edges.groupBy(F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("kind"), "name", "n"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    """src, dst, degree: the first ``k`` distinct neighbours of every node in either direction by id, and how many it has.

    Degrees are counted with map-side combine; of a hub only ``k`` rows reach the window.
    """
    both = undirected(edges)
    w = Window.partitionBy("src").orderBy("dst")
    first = both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
    return first.join(both.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src")


def within(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """seed, node, depth: all nodes within ``hops`` of each seed (column ``seed``) with their least depth, the seed at 0.

    Breadth first: a frontier of (seed, node) is joined with the edges and what was seen before is taken out by an anti-join; lineage is cut each hop.
    """
    links = edges.select("src", "dst").distinct() if directed else undirected(edges)
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, hops + 1):
        ahead = frontier.join(links, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seed, src, dst, rel_type: the distinct edges between the nodes within ``hops`` of each seed."""
    near = within(edges, seeds, hops).select("seed", "node")
    a, b = near.toDF("seed", "src"), near.toDF("seed", "dst")
    return edges.distinct().join(a, "src").join(b, ["seed", "dst"]).select("seed", "src", "dst", "rel_type")


def paths(edges: DataFrame, pairs: DataFrame, hops: int = 4) -> DataFrame:
    """start, goal, hops, path: a shortest path of at most ``hops`` between the ends of each pair, the least by its nodes joined with '>'.

    Pairs without such a path give no row; equal ends give the path of one node. One path is kept per node reached and start.
    """
    links = undirected(edges)
    ends = pairs.select("start", "goal").distinct()
    frontier = ends.select("start", F.col("start").alias("node"), F.col("start").alias("path")).distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        ahead = frontier.join(links, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.min(F.concat_ws(">", "path", "dst")).alias("path"))
        frontier = cut(ahead.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return ends.join(seen.withColumnRenamed("node", "goal"), ["start", "goal"]).select("start", "goal", F.col("depth").alias("hops"), "path")


def search(nodes: DataFrame, pattern: str, k: int = 20) -> DataFrame:
    """id, label, code, score: nodes whose code (0.9) or id (0.7) matches, regardless of case; the best ``k`` by score, then id."""
    code, id_ = F.col("code").rlike(f"(?i){pattern}"), F.col("id").rlike(f"(?i){pattern}")
    return nodes.where(code | id_).withColumn("score", F.when(code, 0.9).otherwise(0.7)).orderBy(F.desc("score"), "id").limit(k)


def context(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """id, context: a node's code with its first ``k`` outgoing relations as text; nodes without relations have their code alone."""
    w = Window.partitionBy("src").orderBy("rel_type", "dst")
    first = edges.distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    text = first.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "rel_type", "dst"))), lambda x: F.concat(x["rel_type"], F.lit("->"), x["dst"])), "; ").alias("rels"))
    return nodes.join(text, nodes["id"] == text["src"], "left").select("id", F.concat_ws(": ", "code", "rels").alias("context"))
