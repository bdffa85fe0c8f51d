"""Attributes of product texts: measures by pattern, keyword rules, coverage, search over the attribute graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmart.functions.text import normalized, tokens
from quillmart.operators.graph import components
from quillmart.plans.canonical import stored

#: Patterns of capacities and sizes, and the confidence of each.
CAPACITY = r"\b(\d+(?:[\.,]\d+)?)\s*(ML|CC|L|LT|LTR|GR|G|KG|MG|W|V)\b"
MOUTH = (r"\b[BTN]\s*([0-9]{2,3})\s*(?:MM)?\b", r"\b([0-9]{2,3})\s*/\s*410\b")
SIZE = r"\b\d+(?:[\.,]\d+)?\s*(?:CM|MM|M)?\s*[*X]\s*\d+(?:[\.,]\d+)?\s*(?:CM|MM|M)?\b"
CONFIDENCE = {"capacity": 0.95, "mouth": 0.92, "size": 0.93}
#: What an attribute edge gives by its distance to the words searched for, 0, 2 and 4 or more.
DECAY = (5, 3, 1)


def plain_upper(text: Column) -> Column:
    """a-z as A-Z, everything outside ASCII a space; null is empty."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", " "), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def measures(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, capacity_value, capacity_unit, mouth_size, size_text and the mean confidence of those found (null if none)."""
    up = df.select(key, plain_upper(F.col(text)).alias("_t"))
    some = lambda pattern, group: F.nullif(F.regexp_extract("_t", pattern, group), F.lit(""))
    unit = some(CAPACITY, 2)
    found = up.select(
        key,
        F.replace(some(CAPACITY, 1), F.lit(","), F.lit(".")).try_cast("double").alias("capacity_value"),
        F.when(unit.isin("LT", "LTR"), "L").when(unit == "G", "GR").otherwise(unit).alias("capacity_unit"),
        F.coalesce(some(MOUTH[0], 1), some(MOUTH[1], 1)).try_cast("double").alias("mouth_size"),
        some(SIZE, 0).alias("size_text"),
    )
    held = [F.when(F.col(c).isNotNull(), v) for c, v in (("capacity_unit", CONFIDENCE["capacity"]), ("mouth_size", CONFIDENCE["mouth"]), ("size_text", CONFIDENCE["size"]))]
    n = sum((F.when(h.isNotNull(), 1).otherwise(0) for h in held), F.lit(0))
    return found.withColumn("confidence", F.round(sum((F.coalesce(h, F.lit(0.0)) for h in held), F.lit(0.0)) / F.nullif(n, F.lit(0)), 6))


def rule_attributes(products: DataFrame, rules: list[tuple[str, str, str, list[str], float]]) -> DataFrame:
    """product_id, attribute, value, confidence by keyword rules (attribute, method, value, keywords, confidence) in their order.

    keyword_first_match keeps the first rule that fits, keyword_any joins all values with |, contains_any and not_contains_any look
    for any keyword anywhere. A keyword of one word must be a word of the name, a phrase may stand anywhere in it. A rule list is
    written by people and small, so each rule is one expression of the same scan.
    """
    named = products.select("product_id", normalized(F.col("product_name")).alias("_name")).withColumn("_words", F.split("_name", " "))
    by_attribute: dict[str, list[Column]] = {}
    first: dict[str, bool] = {}
    for attribute, method, value, keywords, confidence in rules:
        hits = [F.contains("_name", F.lit(k)) if " " in k or method.endswith("contains_any") else F.array_contains("_words", k) for k in keywords]
        hit = F.lit(False)
        for h in hits:
            hit = hit | h
        hit = ~hit if method == "not_contains_any" else hit
        by_attribute.setdefault(attribute, []).append(F.when(hit, F.struct(F.lit(value).alias("value"), F.lit(confidence).alias("confidence"))))
        first[attribute] = method == "keyword_first_match"
    rows = []
    for attribute, found in by_attribute.items():
        fits = F.filter(F.array(*found), lambda x: x.isNotNull())
        fits = F.slice(fits, 1, 1) if first[attribute] else fits
        rows.append(F.struct(F.lit(attribute).alias("attribute"), F.array_join(F.transform(fits, lambda x: x["value"]), "|").alias("value"), F.array_max(F.transform(fits, lambda x: x["confidence"])).alias("confidence")))
    return named.select("product_id", F.explode(F.array(*rows)).alias("r")).select("product_id", "r.*").where("value != ''")


def coverage(attributes: DataFrame, products: DataFrame) -> DataFrame:
    """Per attribute the products that have it, their share, its distinct values and mean confidence."""
    total = products.agg(F.count_distinct("product_id").alias("n"))
    per = attributes.groupBy("attribute").agg(F.count_distinct("product_id").alias("n_products"), F.count_distinct("value").alias("n_values"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return per.crossJoin(F.broadcast(total)).select("attribute", "n_products", "n_values", "mean_confidence", (F.col("n_products") / F.col("n")).alias("share"))


def threshold_sensitivity(edges: DataFrame, products: DataFrame, thresholds: range = range(60, 95, 5)) -> DataFrame:
    """Edges, products and attributes that stay at each least weight, and products left without any."""
    total = products.agg(F.count_distinct("product_id").alias("n"))
    at = edges.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("weight >= threshold")
    per = at.groupBy("threshold").agg(F.count("*").alias("n_edges"), F.count_distinct("product_id").alias("n_products"), F.count_distinct("attribute").alias("n_attributes"))
    return per.crossJoin(F.broadcast(total)).select("threshold", "n_edges", "n_products", "n_attributes", (F.col("n") - F.col("n_products")).alias("n_orphans"))


def focus_subgraph(edges: DataFrame, n_attributes: int = 16, n_products: int = 120) -> DataFrame:
    """Edges among the attributes of most products and the products that have most of those."""
    e = edges.select("product_id", "attribute").distinct()
    top = e.groupBy("attribute").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "attribute").limit(n_attributes).select("attribute")
    near = e.join(F.broadcast(top), "attribute")
    chosen = near.groupBy("product_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "product_id").limit(n_products).select("product_id")
    return near.join(F.broadcast(chosen), "product_id").select("product_id", "attribute")


def singular(word: Column) -> Column:
    """Without a plural ending."""
    shorter = lambda n: F.left(word, F.length(word) - n)
    return F.when(F.endswith(word, F.lit("ES")) & (F.length(word) > 4), shorter(2)).when(F.endswith(word, F.lit("S")) & (F.length(word) > 3), shorter(1)).otherwise(word)


class SearchIndex(NamedTuple):
    """What any number of searches over one attribute graph share; all tables are stored.

    Products with the same attributes and weights are found alike: they are one class, named by its least product, which stands for it.
    edges: product_id, attribute, weight of these, each pair once. near: attribute, other, if some product has both. parts: attribute,
    component. heads: component, product_id, weight of those of most weight in each component. members: class, product_id of the
    first `most` products of each class.
    """

    edges: DataFrame
    near: DataFrame
    parts: DataFrame
    heads: DataFrame
    members: DataFrame
    most: int


def search_index(edges: DataFrame, most: int = 100) -> SearchIndex:
    """most: the largest number of results that a search can ask for."""
    e = stored(edges.groupBy("product_id", "attribute").agg(F.max("weight").alias("weight")), "search-edges")
    # 128 bits name a set of attributes and weights
    sets = e.groupBy("product_id").agg(F.bit_xor(F.xxhash64("attribute", "weight")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "attribute", "weight")).alias("h2"), F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("h1", "h2", "n").orderBy("product_id"))
    placed = sets.withColumn("place", first).where(F.col("place") <= most)
    members = stored(placed.withColumn("class", F.min("product_id").over(Window.partitionBy("h1", "h2", "n"))).select("class", "product_id"), "search-members")
    e = stored(e.join(members.select(F.col("class").alias("product_id")).distinct(), "product_id", "left_semi"), "search-class-edges")
    near = stored(e.select("product_id", "attribute").join(e.select("product_id", F.col("attribute").alias("other")), "product_id").select("attribute", "other").distinct(), "search-near")
    label = components(near.where("attribute != other").select(F.col("attribute").alias("u"), F.col("other").alias("v")))
    parts = stored(near.select("attribute").distinct().join(label.withColumnRenamed("node", "attribute"), "attribute", "left").select("attribute", F.coalesce("label", "attribute").alias("component")), "search-parts")
    whole = e.join(parts, "attribute").groupBy("component", "product_id").agg(F.sum("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.round("weight", 2).desc(), "product_id"))
    heads = stored(whole.withColumn("place", place).where(F.col("place") <= most).drop("place"), "search-heads")
    return SearchIndex(e, near, parts, heads, members, most)


def search_batch(index: SearchIndex, queries: DataFrame, k: int = 10, required: DataFrame | None = None) -> DataFrame:
    """query_id, product_id, relevance, seed_coverage, total_seeds: the k products nearest to the words of each query (query_id, text).

    An attribute gives its edges' weight times 5 if the query names it, 3 if it shares a product with one that the query names, 1
    if it is connected at all; having a share c of the named attributes multiplies that by 20 c^2 + 1. A query that names no
    attribute finds nothing. required: query_id, attribute that each result of the query must have. All queries go through the same joins: what
    is near to the named attributes is summed, and what is only connected enters by the products of most weight. Queries of the same words
    (and required attributes) are answered once.
    """
    if k > index.most:
        raise ValueError("the index keeps fewer products than are asked for")
    words = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("word"))
    wanted = stored(words.select("query_id", F.explode(F.array("word", singular(F.col("word")))).alias("word")).distinct(), "search-wanted")
    said = wanted.groupBy("query_id").agg(F.sort_array(F.collect_set("word")).alias("said"))
    must = None if required is None else required.groupBy("query_id").agg(F.sort_array(F.collect_set("attribute")).alias("must"))
    said = said.withColumn("must", F.array().cast("array<string>")) if must is None else said.join(must, "query_id", "left").withColumn("must", F.coalesce("must", F.array().cast("array<string>")))
    asked = stored(said.withColumn("head", F.min("query_id").over(Window.partitionBy("said", "must"))).select("query_id", "head"), "search-asked")
    heads = asked.select(F.col("head").alias("query_id")).distinct()
    wanted = wanted.join(heads, "query_id", "left_semi")
    required = required if required is None else required.join(heads, "query_id", "left_semi")
    named = index.parts.withColumn("word", F.substring_index("attribute", ":", -1))
    seeds = stored(wanted.join(named, "word").select("query_id", "attribute", "component").distinct(), "search-seeds")
    near = seeds.join(index.near, "attribute").select("query_id", F.col("other").alias("attribute"), F.lit(DECAY[1] - DECAY[2]).alias("more"), F.lit(0).alias("seed")).distinct()
    gains = near.unionByName(seeds.select("query_id", "attribute", F.lit(DECAY[0] - DECAY[1]).alias("more"), F.lit(1).alias("seed")))
    gained = gains.join(index.edges, "attribute").groupBy("query_id", "product_id").agg(F.sum(F.col("more") * F.col("weight")).alias("gain"), F.sum("seed").alias("seed_coverage"))
    lit = seeds.select("query_id", "component").distinct()
    connected = lit.join(index.heads, "component").select("query_id", "product_id")
    tried = gained.select("query_id", "product_id").unionByName(connected)
    if required is not None:
        has = required.select("query_id", "attribute").distinct().withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
        allowed = has.join(index.edges, "attribute").groupBy("query_id", "product_id").agg((F.count("*") == F.first("n")).alias("allowed")).where("allowed").select("query_id", "product_id")
        # a required attribute may be in none of the components that the query's words light up
        inside = allowed.join(index.edges.select("product_id", "attribute"), "product_id").join(index.parts, "attribute").join(lit, ["query_id", "component"], "left_semi").select("query_id", "product_id")
        free = tried.join(has.select("query_id").distinct(), "query_id", "left_anti")
        tried = free.unionByName(inside)
    weight = index.edges.groupBy("product_id").agg(F.sum("weight").alias("weight"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    totals = seeds.groupBy("query_id").agg(F.count_distinct("attribute").alias("total_seeds"))
    scored = tried.distinct().join(weight, "product_id").join(gained, ["query_id", "product_id"], "left").join(totals, "query_id")
    c = zero("seed_coverage") / F.col("total_seeds")
    relevance = F.round((DECAY[2] * F.col("weight") + zero("gain")) * (c * c * 20 + 1), 2)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "product_id"))
    found = scored.select("query_id", "product_id", relevance.alias("relevance"), zero("seed_coverage").cast("long").alias("seed_coverage"), "total_seeds")
    # the first k products are in the first k classes, and of each class they are the first k members
    classes = found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank").withColumnRenamed("product_id", "class")
    spelled = classes.join(index.members, "class").drop("class").withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    return asked.join(spelled.withColumnRenamed("query_id", "head"), "head").select(*found.columns)


def search(edges: DataFrame, query: str, k: int = 10, required: tuple[str, ...] = ()) -> DataFrame:
    """search_batch() for one query; results of any further one should share an index instead."""
    spark = edges.sparkSession
    asked = spark.createDataFrame([(0, query)], "query_id long, text string")
    must = spark.createDataFrame([(0, a) for a in required], "query_id long, attribute string") if required else None
    return search_batch(search_index(edges, k), asked, k, must).drop("query_id")
