"""Communities of weighted graphs by levels: local moves, refinement inside each community, and a graph of the refined parts as the next level.

A level moves nodes to the neighbouring community that gains most modularity. Half of the nodes move at once; if together they do
not gain, only those moves are made that share no community with a better one, whose gains add up. So every round gains, and a level
ends when no single move does, not after a number of rounds. Then each community is taken apart again: single nodes that are well
linked to the rest of it join parts inside it, so parts hang together, and these parts are the nodes of the next level, which starts
from the communities found. The levels end when refinement leaves the graph as it is.

Graphs are tables (u, v, w) with both directions and loops apart; each round is written to the shared folder. Names are strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.operators.graph import class_pairs, components, product_classes, undirected
from quillmart.plans.canonical import stored

#: The least gain of a move, and the least gain of modularity of a round in which many move.
LEAST, LEAST_ROUND = 1e-9, 1e-12


def _half(name: str, i: int) -> Column:
    """Half of all names; two rounds that follow each other have the two halves, and each pair of rounds its own halves."""
    return F.pmod(F.xxhash64(F.lit(i // 2), name), F.lit(2)) == i % 2


def _quality(both: DataFrame, loops: DataFrame, held: DataFrame, total: float) -> float:
    """Modularity of held (node, community, k)."""
    at = lambda c: held.select(F.col("node").alias(c), F.col("community").alias(f"c_{c}"))
    inside = both.join(at("u"), "u").join(at("v"), "v").where("c_u = c_v").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("x"))
    own = loops.agg(F.coalesce(F.sum(2 * F.col("w")), F.lit(0.0)).alias("x"))
    chance = held.groupBy("community").agg(F.sum("k").alias("m")).agg((F.coalesce(F.sum((F.col("m") / total) ** 2), F.lit(0.0)) * -total).alias("x"))
    return inside.union(own).union(chance).agg(F.sum("x")).first()[0] / total


def _moves(both: DataFrame, held: DataFrame, total: float) -> DataFrame:
    """node, own, to, gain: of each node the move that gains most, if any does."""
    mass = held.groupBy("community").agg(F.sum("k").alias("mass"))
    links = both.join(held.select(F.col("node").alias("v"), "community"), "v").groupBy(F.col("u").alias("node"), "community").agg(F.sum("w").alias("w"))
    mine = held.select("node", F.col("community").alias("own"), "k")
    # what a community is worth to a node: its links there less what chance would give, its own weight taken out at home
    home = mine.join(mass.withColumnRenamed("community", "own"), "own").join(links.select("node", F.col("community").alias("own"), F.col("w").alias("w_own")), ["node", "own"], "left")
    home = home.select("node", "own", "k", (F.coalesce("w_own", F.lit(0.0)) - F.col("k") * (F.col("mass") - F.col("k")) / total).alias("at_home"))
    options = links.join(home, "node").where("community != own").join(mass, "community").select("node", "own", "at_home", F.struct((F.col("w") - F.col("k") * F.col("mass") / total).alias("worth"), F.col("community").alias("to")).alias("x"))
    best = options.groupBy("node", "own", "at_home").agg(F.max("x").alias("x"))
    return best.select("node", "own", F.col("x.to").alias("to"), (F.col("x.worth") - F.col("at_home")).alias("gain")).where(F.col("gain") > LEAST)


def _apart(moves: DataFrame) -> DataFrame:
    """Moves that are the best at the community they leave and at the one they join: they touch no community in common, and the best of all is one of them."""
    rank = F.struct("gain", "node")
    best = moves.select(F.explode(F.array("own", "to")).alias("c"), rank.alias("r")).groupBy("c").agg(F.max("r").alias("r")).select("c", F.col("r.node").alias("winner"))
    side = lambda c: best.select(F.col("c").alias(c), F.col("winner").alias("node"))
    return moves.join(side("own"), ["own", "node"], "left_semi").join(side("to"), ["to", "node"], "left_semi")


def _moved(both: DataFrame, loops: DataFrame, held: DataFrame, total: float) -> DataFrame:
    """held after all moves of a level."""
    quality, i = _quality(both, loops, held, total), 0
    after = lambda moves: stored(held.join(moves.select("node", "to"), "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k"), "community")
    while True:
        moves = stored(_moves(both, held, total), "community-moves")
        if moves.isEmpty():
            return held
        trial = after(moves.where(_half("node", i)))
        gained = _quality(both, loops, trial, total)
        if gained < quality + LEAST_ROUND:
            trial = after(_apart(moves))
            gained = _quality(both, loops, trial, total)
        if gained < quality + LEAST_ROUND:
            return held  # what is left to gain is below what sums of doubles can tell
        held, quality, i = trial, gained, i + 1


def _refined(both: DataFrame, held: DataFrame, total: float) -> DataFrame:
    """node, part: parts inside communities. Single nodes with links to the rest of their community as strong as chance gives join the part that gains most."""
    at = lambda c: held.select(F.col("node").alias(c), F.col("community").alias(f"c_{c}"))
    inside = stored(both.join(at("u"), "u").join(at("v"), "v").where("c_u = c_v").select("u", "v", "w"), "community-inside")
    mass = held.groupBy("community").agg(F.sum("k").alias("mass"))
    to_rest = inside.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("rest"))
    able = held.join(mass, "community").join(to_rest, "node").where(F.col("rest") >= F.col("k") * (F.col("mass") - F.col("k")) / total).select("node")
    able = stored(able, "community-able")
    parts, i, still = stored(held.select("node", F.col("node").alias("part"), "k"), "community-parts"), 0, 0
    while still < 2:
        sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("k").alias("mass"))
        single = parts.join(sizes.where("n = 1").select("part"), "part", "left_semi").join(able, "node", "left_semi")
        movers = stored(single.where(_half("node", i)).select("node", "part", "k"), "community-movers")
        # a part that is a mover stays out, so what is joined stays where it is
        fixed = parts.join(movers.select("part"), "part", "left_anti")
        links = inside.join(movers.select(F.col("node").alias("u"), "k"), "u").join(fixed.select(F.col("node").alias("v"), "part"), "v").groupBy(F.col("u").alias("node"), "k", "part").agg(F.sum("w").alias("w"))
        worth = links.join(sizes.select("part", "mass"), "part").select("node", F.struct((F.col("w") - F.col("k") * F.col("mass") / total).alias("worth"), F.col("part").alias("to")).alias("x"))
        joins = stored(worth.groupBy("node").agg(F.max("x").alias("x")).where(F.col("x.worth") > LEAST).select("node", "x.to"), "community-joins")
        still = still + 1 if joins.isEmpty() else 0
        if not still:
            parts = stored(parts.join(joins, "node", "left").select("node", F.coalesce("to", "part").alias("part"), "k"), "community-parts")
        i += 1
    return parts


def two_way(edges: DataFrame, loops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (source, target, weight) as u, v, w in both directions without loops, and the loops as node, w; both summed and stored."""
    named = edges.select(F.col("source").cast("string").alias("u"), F.col("target").cast("string").alias("v"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w")).where("w > 0")
    turned = named.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    both = stored(named.unionByName(turned).where("u != v").groupBy("u", "v").agg(F.sum("w").alias("w")), "community-edges")
    own = named.where("u = v").select(F.col("u").alias("node"), "w")
    if loops is not None:
        own = own.unionByName(loops.select(F.col("node").cast("string"), F.col("weight").cast("double").alias("w")))
    return both, stored(own.groupBy("node").agg(F.sum("w").alias("w")), "community-loops")


def degrees(both: DataFrame, own: DataFrame) -> DataFrame:
    """node, k: all weight at a node, loops twice."""
    return both.select(F.col("u").alias("node"), "w").unionByName(own.select("node", (2 * F.col("w")).alias("w"))).groupBy("node").agg(F.sum("w").alias("k"))


def _levels(both: DataFrame, own: DataFrame, held: DataFrame, total: float) -> DataFrame:
    """node, community after all levels, from a first membership held (node, community, k)."""
    place, n = stored(held.select("node", F.col("node").alias("now")), "community-place"), held.count()
    while True:
        held = _moved(both, own, held, total)
        parts = _refined(both, held, total)
        fewer = parts.select("part").distinct().count()
        if fewer == n:
            return stored(place.join(held.select(F.col("node").alias("now"), "community"), "now").select("node", "community"), "community-end")
        n = fewer
        at = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"p_{c}"))
        lifted = stored(both.join(at("u"), "u").join(at("v"), "v").groupBy(F.col("p_u").alias("u"), F.col("p_v").alias("v")).agg(F.sum("w").alias("w")), "community-edges")
        kept = own.join(parts.select("node", "part"), "node").select(F.col("part").alias("node"), "w")
        own = stored(kept.unionByName(lifted.where("u = v").select(F.col("u").alias("node"), (F.col("w") / 2).alias("w"))).groupBy("node").agg(F.sum("w").alias("w")), "community-loops")
        both = stored(lifted.where("u != v"), "community-edges")
        place = stored(place.join(parts.select(F.col("node").alias("now"), "part"), "now").select("node", F.col("part").alias("now")), "community-place")
        held = stored(parts.join(held.select("node", "community"), "node").groupBy(F.col("part").alias("node"), "community").agg(F.sum("k").alias("k")), "community")


def communities(edges: DataFrame, loops: DataFrame | None = None, passes: int = 2) -> DataFrame:
    """node, community of an undirected weighted graph (source, target, weight; parallel edges add up), every community connected and named by its least node.

    loops: node, weight of links that a node stands for within itself, as a class of equal products does; nodes with loops alone are
    in the graph too. passes: how often all levels are gone through, each time from the communities of the time before.
    """
    both, own = two_way(edges, loops)
    held = stored(degrees(both, own).select("node", F.col("node").alias("community"), "k"), "community")
    total = held.agg(F.sum("k")).first()[0]
    if not total:
        return held.select("node", "community")
    for _ in range(passes):
        end = _levels(both, own, held, total)
        held = held.select("node", "k").join(end, "node").select("node", "community", "k")
    # parts hang together, so this only finds the least name and takes apart what moves of whole parts have cut
    side = lambda c: end.select(F.col("node").alias(c), F.col("community").alias(f"c_{c}"))
    label = components(both.join(side("u"), "u").join(side("v"), "v").where("c_u = c_v").select("u", "v"))
    return end.select("node").join(label, "node", "left").select("node", F.coalesce("label", "node").alias("community"))


def class_graph(edges: DataFrame, hub_share: float = 0.35, least_shared: int = 2, least_similarity: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The product projection by its classes: links (source, target, weight) between them, weights of the links inside them (node, weight), and members (class, product_id).

    A class stands for all its products, so weights are similarities times the numbers of pairs of products.
    """
    classes, members = product_classes(edges, hub_share)
    sizes = classes.select("class", "n")
    pairs = class_pairs(classes, least_shared, least_similarity).select("a", "b", "similarity")
    links = pairs.join(sizes.select(F.col("class").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("class").alias("b"), F.col("n").alias("n_b")), "b")
    links = stored(links.select(F.col("a").alias("source"), F.col("b").alias("target"), (F.col("similarity") * F.col("n_a") * F.col("n_b")).alias("weight")), "projection-links")
    loops = classes.where((F.size("items") >= least_shared) & (F.col("n") > 1)).select(F.col("class").alias("node"), (F.col("n") * (F.col("n") - 1) / 2).alias("weight"))
    return links, loops, members


def product_communities(edges: DataFrame) -> DataFrame:
    """product_id, community, component of the products that the projection links; both are named by their least product."""
    links, loops, members = class_graph(edges)
    found = communities(links, loops)
    label = components(undirected(links, "source", "target"))
    of = found.join(label, "node", "left").select(F.col("node").alias("class"), "community", F.coalesce("label", "node").alias("component"))
    return members.join(of, "class").select("product_id", "community", "component")


def community_quality(edges: DataFrame) -> DataFrame:
    """One row: products, communities, largest_community, components, largest_component, modularity of product_communities()."""
    links, loops, members = class_graph(edges)
    found = stored(communities(links, loops), "community-found")
    both, own = two_way(links, loops)
    total = degrees(both, own).agg(F.sum("k")).first()[0]
    value = _quality(both, own, degrees(both, own).join(found, "node"), total) if total else None
    label = components(undirected(links, "source", "target"))
    rows = members.join(found.join(label, "node", "left").select(F.col("node").alias("class"), "community", F.coalesce("label", "node").alias("component")), "class")
    sizes = lambda c, name: rows.groupBy(c).count().agg(F.count("*").alias(name), F.coalesce(F.max("count"), F.lit(0)).alias(f"largest_{c}"))
    counts = rows.agg(F.count("*").alias("products")).crossJoin(sizes("community", "communities")).crossJoin(sizes("component", "components"))
    return counts.withColumn("modularity", F.round(F.lit(value).cast("double"), 6))
