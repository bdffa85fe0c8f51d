"""Graphs as node and edge DataFrames; loops write each round to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmart.functions.text import normalized, tokens
from quillmart.plans.canonical import stored


def attribute_edges(products: DataFrame) -> DataFrame:
    """Product to attribute: words of the name, category and brand, each once."""
    words = lambda c, relation, weight: products.select("product_id", F.explode(F.array_distinct(tokens(F.col(c)))).alias("value"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight"))
    whole = products.select("product_id", normalized(F.col("brand")).alias("value"), F.lit("BRAND").alias("relation"), F.lit(80).alias("weight"))
    edges = words("product_name", "WORD", 90).unionByName(words("category", "CATEGORY", 75)).unionByName(whole)
    return edges.select("product_id", F.concat_ws(":", "relation", "value").alias("attribute"), "relation", "weight")


def attribute_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("attribute").agg(F.count_distinct("product_id").alias("degree"))


def product_classes(edges: DataFrame, hub_share: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """Products with equal attributes and weights as one class: (class, n, mass, items), items being its attributes from rare to common, and (class, product_id). Attributes of too many products are left out first.

    A class is named by its least product. No row holds the members of a class.
    """
    n = edges.agg(F.count_distinct("product_id").alias("n"))
    kept = attribute_degrees(edges).crossJoin(F.broadcast(n)).where(F.col("degree") <= F.greatest(F.lit(2), F.floor(F.lit(hub_share) * F.col("n")))).select("attribute", "degree")
    used = edges.join(kept, "attribute").groupBy("product_id", "attribute", "degree").agg(F.max("weight").alias("w"))
    sets = stored(used.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("degree", "attribute", "w"))).alias("items")), "projection-sets")
    classes = stored(sets.groupBy("items").agg(F.min("product_id").alias("class"), F.count("*").alias("n")), "projection-classes")
    mass = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["w"])
    return classes.select("class", "n", mass.alias("mass"), "items"), sets.join(classes.select("items", "class"), "items").select("class", "product_id")


def class_pairs(classes: DataFrame, least_shared: int = 2, least_similarity: float = 0.3) -> DataFrame:
    """a, b (a < b), n_shared, shared_weight, similarity of classes that are alike enough by weighted Jaccard.

    Two alike classes share weight of at least least_similarity times the mass of either. All that they share comes from their rarest
    shared attribute on, so that attribute has at least this much weight from itself on in both: only attributes that have are joined on,
    which leaves out the most common ones, and only where the smaller mass allows the similarity. Pairs are then measured on all attributes.
    """
    behind = F.col("mass") - F.aggregate(F.slice("items", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    front = classes.select("class", "mass", "items", F.posexplode("items").alias("i", "item")).where(behind >= F.col("mass") * least_similarity).select("class", "mass", "item.attribute")
    both = front.alias("x").join(front.alias("y"), (F.col("x.attribute") == F.col("y.attribute")) & (F.col("x.class") < F.col("y.class")) & (F.least("x.mass", "y.mass") >= F.greatest("x.mass", "y.mass") * least_similarity))
    tried = both.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    side = lambda c: classes.select(F.col("class").alias(c), F.col("mass").alias(f"mass_{c}"), F.map_from_arrays("items.attribute", "items.w").alias(f"w_{c}"))
    pairs = tried.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.array_intersect(F.map_keys("w_a"), F.map_keys("w_b")))
    shared = F.aggregate("common", F.lit(0).cast("long"), lambda s, t: s + F.least(F.col("w_a")[t], F.col("w_b")[t]))
    near = pairs.where(F.size("common") >= least_shared).select("a", "b", F.size("common").cast("long").alias("n_shared"), shared.alias("shared_weight"), (F.col("mass_a") + F.col("mass_b")).alias("mass"))
    return near.select("a", "b", "n_shared", "shared_weight", (F.col("shared_weight") / (F.col("mass") - F.col("shared_weight"))).alias("similarity")).where(F.col("similarity") >= least_similarity)


def product_projection(edges: DataFrame, hub_share: float = 0.35, least_shared: int = 2, least_similarity: float = 0.3) -> DataFrame:
    """Products that share attributes, by weighted Jaccard. Pairs are found between classes of equal products and spelled out here, which is as large as the result itself."""
    classes, members = product_classes(edges, hub_share)
    own = classes.where((F.size("items") >= least_shared) & (F.col("n") > 1)).select(F.col("class").alias("a"), F.col("class").alias("b"), F.size("items").cast("long").alias("n_shared"), F.col("mass").alias("shared_weight"), F.lit(1.0).alias("similarity"))
    side = lambda c: members.select(F.col("class").alias(c), F.col("product_id").alias(f"p_{c}"))
    pairs = class_pairs(classes, least_shared, least_similarity).unionByName(own).join(side("a"), "a").join(side("b"), "b").where("a != b or p_a < p_b")
    return pairs.select(F.least("p_a", "p_b").alias("product_a"), F.greatest("p_a", "p_b").alias("product_b"), "n_shared", "shared_weight", "similarity")


def top_similar(projection: DataFrame, k: int = 5) -> DataFrame:
    both = projection.select(F.col("product_a").alias("product_id"), F.col("product_b").alias("other"), "similarity").unionByName(projection.select(F.col("product_b").alias("product_id"), F.col("product_a").alias("other"), "similarity"))
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("similarity").desc(), "other"))
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def top_similar_products(edges: DataFrame, k: int = 5, hub_share: float = 0.35, least_shared: int = 2, least_similarity: float = 0.3) -> DataFrame:
    """top_similar() of product_projection(), without spelling its pairs out.

    Products of a class are alike to the same others, so one ranking holds for the class: of each other class its first k members by
    name can be among the best, and of its own class the first k + 1, as a product is none of its own best.
    """
    classes, members = product_classes(edges, hub_share)
    members = stored(members, "similar-members")
    place = F.row_number().over(Window.partitionBy("class").orderBy("product_id"))
    first = stored(members.withColumn("place", place).where(F.col("place") <= k + 1).select(F.col("class").alias("b"), F.col("product_id").alias("other")), "similar-first")
    pairs = stored(class_pairs(classes, least_shared, least_similarity).select("a", "b", "similarity"), "similar-pairs")
    own = classes.where((F.size("items") >= least_shared) & (F.col("n") > 1)).select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(own)
    # the classes of the k + 1 best members are among the k + 1 best classes or as good as the last of them
    near = F.rank().over(Window.partitionBy("a").orderBy(F.col("similarity").desc()))
    best = both.withColumn("near", near).where(F.col("near") <= k + 1).join(first, "b")
    order = F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "other"))
    kept = best.withColumn("rank", order).where(F.col("rank") <= k + 1).select(F.col("a").alias("class"), "other", "similarity")
    every = members.join(kept, "class").where("product_id != other").select("product_id", "other", "similarity")
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("similarity").desc(), "other"))
    return every.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def attribute_cooccurrence(edges: DataFrame, least: int = 3) -> DataFrame:
    e = edges.select("product_id", "attribute").distinct()
    both = e.alias("x").join(e.alias("y"), (F.col("x.product_id") == F.col("y.product_id")) & (F.col("x.attribute") < F.col("y.attribute")))
    return both.groupBy(F.col("x.attribute").alias("attribute_a"), F.col("y.attribute").alias("attribute_b")).agg(F.count("*").alias("n_products")).where(F.col("n_products") >= least)


def transaction_edges(lines: DataFrame, party: str, relation: str) -> DataFrame:
    """Documents (a counterparty's day) with their products, counterparty and date."""
    named = lines.where("is_active").withColumn("doc", F.concat_ws("|", F.lit("DOC"), party, F.col("date").cast("string")))
    contains = named.select(F.col("doc").alias("source"), F.concat(F.lit("PRODUCT|"), "product_id").alias("target"), F.lit("CONTAINS").alias("relation"), F.col("total").alias("weight"))
    docs = named.select("doc", party, "date").distinct()
    by = docs.select(F.col("doc").alias("source"), F.concat(F.lit("PARTY|"), party).alias("target"), F.lit(relation).alias("relation"), F.lit(1).cast("long").alias("weight"))
    on = docs.select(F.col("doc").alias("source"), F.concat(F.lit("DATE|"), F.col("date").cast("string")).alias("target"), F.lit("ON_DATE").alias("relation"), F.lit(1).cast("long").alias("weight"))
    return contains.unionByName(by).unionByName(on)


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n_edges"), F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"))


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    return e.union(e.select("v", "u")).distinct()


def hop_distances(both: DataFrame, start: str) -> DataFrame:
    """Breadth-first distances from a node over symmetric edges (u, v); each round joins the frontier alone.

    A neighbour of a level lies in that level, the one before or the next, so those two are all that a round looks back at.
    """
    both = stored(both, "bfs-edges")
    level = stored(both.where(F.col("u") == start).select(F.col("u").alias("node"), F.lit(0).cast("long").alias("distance")).distinct(), "bfs")
    seen, before, depth = level, level, 0
    while True:
        depth += 1
        near = level.select("node").union(before.select("node"))
        found = both.join(level.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct().join(near, "node", "left_anti")
        before, level = level, stored(found.withColumn("distance", F.lit(depth).cast("long")), "bfs-level")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
        if depth % 8 == 0:
            seen = stored(seen, "bfs")


def components(both: DataFrame) -> DataFrame:
    """Least node of each component, by least labels that jump to their labels' labels."""
    both = stored(both, "component-edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "component")
    while True:
        around = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(lower.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "component")
        labels = after.select("node", "label")
        if after.where("old != label").isEmpty():
            return labels


def pagerank(edges: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """PageRank of a symmetric weighted graph (u, v, w) after a fixed number of rounds from equal ranks.

    The moves are laid out by u once, so a round only shuffles ranks; ranks are stored every five rounds.
    """
    out = edges.groupBy("u").agg(F.sum("w").alias("out"))
    moves = stored(edges.join(out, "u").select("u", "v", (F.col("w") / F.col("out")).alias("p")), "rank-moves").repartition("u").persist()
    n = out.count()
    ranks = moves.select(F.col("u").alias("node")).distinct().withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(1, rounds + 1):
        given = moves.join(ranks.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("given"))
        ranks = given.select("node", (F.lit((1 - damping) / n) + damping * F.col("given")).alias("rank"))
        if i % 5 == 0 or i == rounds:
            ranks = stored(ranks, "rank")
    moves.unpersist()
    return ranks
