"""Cross-file links: alias references, build contexts, promotion of workloads to agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import place


def resolve_refs(refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved). A ref that is a node id binds to it alone, else to every node with that alias.

    refs: src, ref, rel, file, line, seq. Edge seq is that of the ref, then the target's position.
    Both joins are equi-joins; nothing is broadcast by force.
    """
    ids = nodes.select(F.col("id").alias("ref"), F.col("id").alias("dst"), "seq")
    exact = refs.join(ids.select("ref", "dst", F.col("seq").alias("target_seq")), "ref", "left")
    alias = nodes.select(F.col("id").alias("alias_dst"), F.col("seq").alias("alias_seq"), F.explode("aliases").alias("ref"))
    both = exact.join(alias, (exact["ref"] == alias["ref"]) & exact["dst"].isNull(), "left").drop(alias["ref"])
    resolved = both.select("src", "ref", "rel", "file", "line", "seq", F.coalesce("dst", "alias_dst").alias("dst"), F.coalesce("target_seq", "alias_seq").alias("target_seq"))
    seq = F.col("seq").withField("sub", F.array(place(F.col("target_seq"))))
    edges = resolved.where("dst is not null").select("src", "dst", "rel", "file", "line", F.lit(True).alias("transitive"), seq.alias("seq"))
    return edges, resolved.where("dst is null").drop("dst", "target_seq")


def contained(paths: DataFrame, folders: DataFrame, path: str, folder: str) -> DataFrame:
    """Pairs whose path lies below the folder: an equi-join on the path's own ancestors.

    A path has as many ancestors as levels, so rows grow with depth and not with the number of
    folders; a prefix comparison of all pairs would not scale.
    """
    parts = F.split(F.col(path), "/", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    exploded = paths.where(F.col(path).contains("/")).withColumn("_folder", F.explode(ancestors))
    key = F.regexp_replace(F.col(folder), "/+$", "")
    return exploded.join(folders.withColumn("_folder", key), "_folder").drop("_folder")


def promotable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hinted nodes that no edge from an agent points at yet."""
    agents = nodes.where("kind = 'agent'").select(F.col("id").alias("src"))
    run_as = edges.join(agents, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return nodes.where("agent_hint").join(run_as, "id", "left_anti")


def mesh(members: DataFrame) -> DataFrame:
    """Edges of shared networks in linear form: net, member, kind ('attached' or 'reach'), at, line.

    members: net, member, pos, line; pos orders a network's members. Every member attaches to its
    network, and the network reaches each member that has another beside it; members 2, 3, ... come
    before the first, as in the nested loop over pairs, which would be quadratic.
    """
    one = members.groupBy("net", "member").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"))
    nets = one.groupBy("net").agg(F.count("*").alias("n"), F.min("pos").alias("head"))
    joined = one.join(nets, "net")
    attached = joined.select("net", "member", F.lit("attached").alias("kind"), F.lit(0).alias("last"), "pos", "line")
    reached = joined.where("n > 1").select("net", "member", F.lit("reach").alias("kind"), F.when(F.col("pos") == F.col("head"), 1).otherwise(0).alias("last"), "pos", "line")
    return attached.unionByName(reached)


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges in and out of every node that has any; both ends are pre-aggregated before the shuffle."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def edge_families(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with family: network for reach without access, else by the kind of the target."""
    kinds = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    family = (
        F.when(~F.col("transitive") | F.col("rel").startswith("attached to") | F.col("rel").startswith("can reach"), "net")
        .when(F.col("dst_kind") == "tool", "uses").when(F.col("dst_kind") == "identity", "runs")
        .when(F.col("dst_kind") == "secret", "secret").otherwise("priv")
    )
    return edges.join(kinds, "dst", "left").withColumn("family", family)


def neighbourhood(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """Ids of nodes whose id or label holds text in any case, and of those one edge away: id, hit."""
    needle = F.lit(text.lower())
    return around(nodes.where(F.lower("id").contains(needle) | F.lower("label").contains(needle)).select("id"), edges)


def around(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits and what is one edge away: id, hit."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    near = ends.join(hits, "id", "left_semi").select(F.col("other").alias("id"), F.lit(False).alias("hit"))
    return hits.withColumn("hit", F.lit(True)).unionByName(near).groupBy("id").agg(F.bool_or("hit").alias("hit"))
