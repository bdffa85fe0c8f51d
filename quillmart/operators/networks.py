"""Measures of whole graphs: metrics, ranks to convergence, betweenness, communities; loops write each round to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmart.functions.text import normalized
from quillmart.operators.graph import components
from quillmart.plans.canonical import stored

#: The least weight of an edge in a walk, and the change of all ranks together that ends the rounds.
LEAST_WEIGHT, STOP = 1e-9, 1e-8


def both_ways(edges: DataFrame) -> DataFrame:
    """u, v, w of undirected edges (source, target, weight), in both directions; parallel edges stay apart."""
    w = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)), F.lit(LEAST_WEIGHT)).alias("w")
    return edges.select(F.col("source").alias("u"), F.col("target").alias("v"), w).unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v"), w))


def walk_ranks(both: DataFrame, restarts: DataFrame, by: list[str], damping: float, stop: float, most_rounds: int) -> DataFrame:
    """rank for each node (and what else is in `by`) of walks over a symmetric weighted graph (u, v, w); restarts: the columns of `by` and restart, of nodes of the graph.

    Ranks are what one more step of the walk leaves as it is: a linear system, symmetric and positive definite when values are weighed by
    1 / out. Conjugate gradients solve it: each round sends one direction over the edges, as a step of the walk would, and errors fall at
    least as 0.56 to the rounds for a damping of 0.85 (the walk: 0.85). Rounds end when a further step would change the ranks
    of every walk by less than `stop` together. Each round is stored; of it only its sums are looked at.
    """
    walk = [c for c in by if c != "node"]
    weights = both.groupBy("u", "v").agg(F.sum("w").alias("w"))
    out = stored(weights.groupBy(F.col("u").alias("node")).agg(F.sum("w").cast("double").alias("out")), "walk-out")
    moves = stored(weights.join(out.select(F.col("node").alias("u"), "out"), "u").join(out.select(F.col("node").alias("v"), F.col("out").alias("out_v")), "v").select("u", "v", (F.col("w") / F.col("out")).alias("p"), "out_v"), "walk-moves").repartition("u").persist()
    whole = out.agg(F.coalesce(F.sum("out"), F.lit(0.0))).first()[0]
    zero = F.lit(0.0)
    state = restarts.join(out, "node").select(*by, "out", zero.alias("x"), ((1 - damping) * F.col("restart")).alias("r"), ((1 - damping) * F.col("restart")).alias("d"))
    for _ in range(most_rounds):
        sent = state.select(*walk, F.col("node").alias("u"), "d").where("d != 0").join(moves, "u").select(*walk, F.col("v").alias("node"), F.col("out_v").alias("out"), zero.alias("x"), zero.alias("r"), zero.alias("d"), (-damping * F.col("d") * F.col("p")).alias("q"))
        kept = state.select(*by, "out", "x", "r", "d", F.col("d").alias("q"))
        state = stored(kept.unionByName(sent).groupBy(*by).agg(F.max("out").alias("out"), *[F.sum(c).alias(c) for c in ("x", "r", "d", "q")]), "walk")
        dot = lambda a, b: F.sum(F.col(a) * F.col(b) / F.col("out"))
        sums = state.groupBy(*walk).agg(dot("r", "r").alias("rr"), dot("r", "q").alias("rq"), dot("q", "q").alias("qq"), dot("d", "q").alias("dq"))
        alpha = F.when(F.col("dq") > 0, F.col("rr") / F.col("dq")).otherwise(0.0)
        left = F.greatest(F.col("rr") - 2 * alpha * F.col("rq") + alpha * alpha * F.col("qq"), zero)
        done = F.sqrt(left * whole) < stop  # the sum of all residuals is at most this root
        steps = stored(sums.select(*walk, alpha.alias("alpha"), F.when(done | (F.col("rr") <= 0), 0.0).otherwise(left / F.col("rr")).alias("beta"), done.alias("done")), "walk-steps")
        met = state.join(F.broadcast(steps), walk) if walk else state.crossJoin(F.broadcast(steps))
        r = F.col("r") - F.col("alpha") * F.col("q")
        # what is done rests: no direction is left
        state = met.select(*by, "out", (F.col("x") + F.col("alpha") * F.col("d")).alias("x"), F.when(F.col("done"), 0.0).otherwise(r).alias("r"), F.when(F.col("done"), 0.0).otherwise(r + F.col("beta") * F.col("d")).alias("d"))
        if steps.where("not done").isEmpty():
            break
    state = stored(state, "walk-ranks")
    moves.unpersist()
    return state.select(*by, F.col("x").alias("rank"))


def pagerank_converged(both: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, most_rounds: int = 100, stop: float = STOP) -> DataFrame:
    """node, rank of a symmetric weighted graph (u, v, w), to the ranks that a further step changes by less than `stop` together.

    seeds: node, weight of restarts; none restarts anywhere alike.
    """
    nodes = stored(both.select(F.col("u").alias("node")).distinct(), "rank-nodes")
    if seeds is None:
        start = nodes.withColumn("restart", F.lit(1.0 / max(nodes.count(), 1)))
    else:
        total = F.broadcast(seeds.agg(F.sum("weight").alias("all")))
        start = nodes.join(seeds.crossJoin(total).groupBy("node").agg(F.sum(F.col("weight") / F.col("all")).alias("restart")), "node", "left").withColumn("restart", F.coalesce("restart", F.lit(0.0)))
    return walk_ranks(both, start, ["node"], damping, stop, most_rounds)


def top_nodes(ranks: DataFrame, nodes: DataFrame, kinds: tuple[str, ...], k: int = 10, exclude: tuple[str, ...] = ()) -> DataFrame:
    """node_id, node_type, label, score of the k highest ranks among some kinds of nodes. nodes: node_id, node_type, label."""
    kept = nodes.where(F.col("node_type").isin(*kinds) & ~F.col("node_id").isin(*exclude))
    return kept.join(ranks.withColumnRenamed("node", "node_id"), "node_id").select("node_id", "node_type", "label", F.round("rank", 6).alias("score")).orderBy(F.col("score").desc(), "node_id").limit(k)


def co_documents(edges: DataFrame, product: str) -> DataFrame:
    """node_id, co_docs: other products in the documents of one product, over CONTAINS edges (document, product)."""
    held = edges.where("relation = 'CONTAINS'").select("source", "target").distinct()
    docs = held.where(F.col("target") == product).select("source")
    return held.join(docs, "source", "left_semi").where(F.col("target") != product).groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("co_docs"))


def find_nodes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """text, node_id of every text that names a node: by id, by its whole normalised label, or by a part of it (each the least id).

    Parts are looked up by runs of as many characters as the text has, three at most, so that is a hash join too.
    """
    asked = texts.select("text").where("text is not null").distinct().withColumn("plain", normalized(F.col("text")))
    named = nodes.select("node_id", normalized(F.col("label")).alias("name")).where("name != ''")
    hit = lambda df, tier: df.select("text", F.lit(tier).alias("tier"), "node_id")
    by_id = hit(asked.join(nodes.select("node_id"), F.col("text") == F.col("node_id")), 1)
    whole = hit(asked.join(named, F.col("plain") == F.col("name")), 2)
    # of all names that hold a run the least id is enough where the text is the run itself
    cut = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - (n - 1)), lambda i: F.col("name").substr(i, F.lit(n))))
    runs = lambda n: named.where(F.length("name") >= n).select("node_id", "name", F.explode(cut(n)).alias("run"))
    part = hit(asked.where(F.length("plain") >= 3).withColumn("run", F.substring("plain", 1, 3)).join(runs(3), "run").where(F.contains("name", "plain")), 3)
    best = F.min(F.struct("tier", "node_id")).alias("best")
    for n in (1, 2):
        least = runs(n).groupBy("run").agg(F.min("node_id").alias("node_id"))
        part = part.unionByName(hit(asked.where(F.length("plain") == n).join(least, F.col("plain") == F.col("run")), 3))
    return by_id.unionByName(whole).unionByName(part).groupBy("text").agg(best).select("text", "best.node_id")


def graph_metrics(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """metric, value: counts of nodes by type and of edges by relation, components and the largest of them, products with and without edges, and the k highest degrees (distinct neighbours)."""
    row = lambda df, prefix, name, value: df.select(F.concat(F.lit(prefix), name).alias("metric"), value.cast("long").alias("value"))
    types = nodes.groupBy("node_type").agg(F.count("*").alias("n"))
    relations = edges.groupBy("relation").agg(F.count("*").alias("n"))
    around = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v"))).distinct()
    around = stored(around, "metrics-around")
    degree = around.groupBy("u").agg(F.count("*").alias("degree"))
    labels = components(around)
    alone = nodes.select("node_id").join(labels.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).select("n").unionByName(alone.select(F.lit(1).cast("long").alias("n")))
    whole = sizes.agg(F.count("*").alias("connected_components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_component"))
    products = nodes.where("node_type = 'PRODUCT'").join(degree.select(F.col("u").alias("node_id"), "degree"), "node_id", "left").agg(F.count("*").alias("products_total"), F.count("degree").alias("products_with_edges"), (F.count("*") - F.count("degree")).alias("products_without_edges"))
    flat = lambda df: df.unpivot([], df.columns, "metric", "value")
    top = degree.orderBy(F.col("degree").desc(), "u").limit(k)
    return row(types, "nodes:", F.col("node_type"), F.col("n")).unionByName(row(relations, "edges:", F.col("relation"), F.col("n"))).unionByName(flat(whole)).unionByName(flat(products)).unionByName(row(top, "degree:", F.col("u"), F.col("degree")))


def components_by_threshold(edges: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """threshold, n_nodes, n_components, largest: parts of the graph that edges of each least weight leave. One loop for all: nodes carry their threshold."""
    level = edges.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("weight >= threshold")
    name = lambda c: F.concat(F.col("threshold").cast("string"), F.lit("|"), c)
    e = level.select(name(F.col("source")).alias("u"), name(F.col("target")).alias("v"))
    sizes = components(e.union(e.select("v", "u")).distinct()).groupBy("label").agg(F.count("*").alias("n"))
    at = F.substring_index("label", "|", 1).cast("double")
    return sizes.groupBy(at.alias("threshold")).agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_components"), F.max("n").alias("largest"))


def betweenness(around: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, betweenness over symmetric edges (u, v): shortest paths through each node, of all pairs or of those that start at `sources` (node).

    Nodes with the same neighbours, all of them sources or none, lie on the same number of paths: they are one class, and one source
    of a class speaks for all. All classes go in one loop: forwards level by level with the number of shortest paths, then backwards with the
    share of each node's dependants. Rows are (source, node) of classes, so a large graph without equal nodes is given a set of sources. As
    paths count from both ends, sums are halved.
    """
    every = stored(around.select("u", "v").distinct(), "between-edges")
    real = every.where("u != v")
    # 128 bits name a set of neighbours
    sets = real.groupBy(F.col("u").alias("node")).agg(F.bit_xor(F.xxhash64("v")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "v")).alias("h2"), F.count("*").alias("n"))
    asked = sets.withColumn("asked", F.lit(True)) if sources is None else sets.join(sources.select("node").distinct().withColumn("asked", F.lit(True)), "node", "left")
    named = stored(asked.withColumn("asked", F.coalesce("asked", F.lit(False))), "between-sets")
    classes = stored(named.groupBy("h1", "h2", "n", "asked").agg(F.min("node").alias("class"), F.count("*").alias("m")), "between-classes")
    size = classes.select(F.col("class").alias("node"), "m")
    edges = stored(real.join(size.select(F.col("node").alias("u")), "u", "left_semi").join(size.select(F.col("node").alias("v")), "v", "left_semi"), "between-around").withColumnRenamed("u", "node")
    # times: nodes of the class that stand at this place, without the source itself
    level = stored(classes.where("asked").select(F.col("class").alias("source"), F.col("class").alias("node"), F.lit(1.0).alias("paths"), F.lit(1).cast("long").alias("times")), "between-level")
    levels, seen = [level], None
    while True:
        met = level.join(edges, "node").groupBy("source", F.col("v").alias("node")).agg(F.sum(F.col("paths") * F.col("times")).alias("paths"))
        new = met if seen is None else met.join(seen, ["source", "node"], "left_anti")
        own = F.when(F.col("node") == F.col("source"), 1).otherwise(0)
        level = stored(new.join(size, "node").select("source", "node", "paths", (F.col("m") - own).alias("times")).where("times > 0"), "between-level")
        if level.isEmpty():
            break
        levels.append(level)
        # every path of a level's neighbours ends in this level, the one before or the one after; a source's own class comes again, without it
        seen = levels[-1].select("source", "node") if len(levels) == 2 else levels[-1].select("source", "node").unionByName(levels[-2].select("source", "node"))
    below, parts = None, []
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
        owed = lower.withColumn("owed", F.lit(0.0)) if below is None else lower.join(below, ["source", "node"], "left").withColumn("owed", F.coalesce("owed", F.lit(0.0)))
        parts.append(owed.select("source", "node", "owed"))
        given = owed.select("source", F.col("node").alias("v"), ((1 + F.col("owed")) * F.col("times") / F.col("paths")).alias("share"))
        crossed = upper.join(edges, "node").join(given, ["source", "v"])
        below = stored(crossed.groupBy("source", "node").agg(F.sum(F.col("paths") * F.col("share")).alias("owed")), "between-owed")
    whole = size.select("node", F.lit(0.0).alias("owed"))
    for p in parts:
        many = F.when(F.col("node") == F.col("source"), F.col("m") - 1).otherwise(F.col("m"))
        whole = whole.unionByName(p.join(size.select(F.col("node").alias("source"), "m"), "source").select("node", (F.col("owed") * many).alias("owed")))
    of = whole.groupBy(F.col("node").alias("class")).agg((F.sum("owed") / 2).alias("betweenness"))
    found = named.join(classes, ["h1", "h2", "n", "asked"]).select("node", "class").join(of, "class").select("node", "betweenness")
    return every.select(F.col("u").alias("node")).distinct().join(found, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: n_communities, largest, modularity of a membership (node, community)."""
    both = both_ways(edges).where("u != v")
    side = lambda c: membership.select(F.col("node").alias(c), F.col("community").alias(f"community_{c}"))
    per = both.join(side("u"), "u").join(side("v"), "v").groupBy(F.col("community_u").alias("community")).agg(F.sum("w").alias("mass"), F.sum(F.when(F.col("community_u") == F.col("community_v"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = F.broadcast(per.agg(F.sum("mass").alias("all")))
    value = per.crossJoin(total).agg(F.round(F.sum(F.col("inside") / F.col("all") - (F.col("mass") / F.col("all")) ** 2), 6).alias("modularity"))
    sizes = membership.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_communities"), F.max("n").alias("largest"))
    return sizes.crossJoin(F.broadcast(value))


def describe_communities(membership: DataFrame, labels: DataFrame, least: int = 3, k: int = 5) -> DataFrame:
    """community, size, top_terms, samples of communities of `least` nodes or more. labels: node, label."""
    named = membership.join(labels, "node")
    sizes = named.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    place = F.row_number().over(Window.partitionBy("community").orderBy("label"))
    shown = named.select("community", "label").distinct().withColumn("place", place).where("place <= 3")
    sizes = sizes.join(shown.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("label")), " | ").alias("samples")), "community", "left")
    words = named.select("community", F.explode(F.filter(F.split(normalized(F.col("label")), " "), lambda t: F.length(t) > 2)).alias("word")).groupBy("community", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.col("n").desc(), "word"))
    terms = words.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("top_terms"))
    return sizes.join(terms, "community", "left").select("community", "size", "top_terms", "samples")


def neighbourhood(edges: DataFrame, centres: DataFrame, k: int = 35) -> DataFrame:
    """centre, product, attribute: of each centre attribute up to k products (by their number of attributes), with all their attributes. edges: product_id, attribute; centres: attribute."""
    e = edges.select("product_id", "attribute").distinct()
    degree = e.groupBy("product_id").agg(F.count("*").alias("degree"))
    rank = F.row_number().over(Window.partitionBy("centre").orderBy(F.col("degree").desc(), "product_id"))
    near = e.join(centres.select("attribute").distinct(), "attribute").select(F.col("attribute").alias("centre"), "product_id").join(degree, "product_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return near.select("centre", "product_id").join(e, "product_id").select("centre", "product_id", "attribute")


def transaction_nodes(edges: DataFrame, products: DataFrame) -> DataFrame:
    """node_id, node_type, label of the ends of transaction edges; products carry their names, the others what follows the first |."""
    ends = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id"))).distinct()
    kind = F.substring_index("node_id", "|", 1)
    named = products.select(F.concat(F.lit("PRODUCT|"), "product_id").alias("node_id"), "product_name")
    return ends.join(named, "node_id", "left").select("node_id", kind.alias("node_type"), F.coalesce("product_name", _after("node_id")).alias("label"))


def _after(column: str) -> Column:
    return F.expr(f"substr({column}, instr({column}, '|') + 1)")
