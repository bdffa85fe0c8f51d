"""One attribute row per product, the graph that these rows make, and reports that compare, review and sample them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmart.functions import rules as defaults
from quillmart.functions.text import STOP_WORDS, normalized, plain_number, tokens
from quillmart.operators.attributes import CAPACITY, MOUTH, SIZE
from quillmart.operators.attributes import CONFIDENCE as MEASURED

RULED = ("product_type", "subtype", "accessory", "shape", "feature", "use_category")
#: Attribute column, node type, relation and confidence key of the attribute graph.
GRAPH = (
    ("product_type", "TYPE", "HAS_TYPE", "product_type"),
    ("subtype", "SUBTYPE", "HAS_SUBTYPE", "subtype"),
    ("accessory", "ACCESSORY", "HAS_ACCESSORY", "accessory"),
    ("shape", "SHAPE", "HAS_SHAPE", "shape"),
    ("feature", "FEATURE", "HAS_FEATURE", "feature"),
    ("material", "MATERIAL", "HAS_MATERIAL", "material"),
    ("color", "COLOR", "HAS_COLOR", "color"),
    ("capacity_text", "CAPACITY", "HAS_CAPACITY", "capacity"),
    ("mouth_size_text", "MOUTH_SIZE", "HAS_MOUTH_SIZE", "mouth_size"),
)
LEAST_CONFIDENCE = 0.75
#: Tokens that no rule is missing for.
PLAIN_TOKENS = (r"^\d+$", r"^\d+(ML|CC|L|LT|GR|G|KG|MG|MM|CM|UND|UNID)$", r"^[BTN]?\d{2,3}$")
REPORTED = ("product_type", "subtype", "material", "color", "accessory", "shape", "feature", "capacity_value", "mouth_size_mm", "size_text", "closure_type", "use_category", "material_family")
COMPARED = ("product_type", "subtype", "accessory", "shape", "feature", "material", "color", "capacity_value", "capacity_unit", "mouth_size_mm", "use_category", "material_family")


def rule_value(rules: list, attribute: str, name: Column, words: Column) -> Column:
    """Struct of value and confidence that an attribute's rules give a normalised name; null fields if none fits."""
    mine = [r for r in rules if r[0] == attribute]
    fits = []
    for _, method, value, keywords, confidence in mine:
        plain = [k for k in keywords if " " not in k]
        hit = F.arrays_overlap(words, F.array(*map(F.lit, plain))) if plain else F.lit(False)
        for phrase in (k for k in keywords if " " in k):
            hit = hit | F.contains(name, F.lit(phrase))
        fits.append(F.when(~hit if method == "not_contains_any" else hit, F.struct(F.lit(value).alias("value"), F.lit(float(confidence)).alias("confidence"))))
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("confidence"))
    if not fits:
        return none
    if mine[0][1] == "keyword_first_match":
        return F.coalesce(*fits, none)
    found = F.filter(F.array(*fits), lambda x: x.isNotNull())
    joined = F.struct(F.array_join(F.array_distinct(F.transform(found, lambda x: x["value"])), "|").alias("value"), F.array_max(F.transform(found, lambda x: x["confidence"])).alias("confidence"))
    return F.when(F.size(found) > 0, joined).otherwise(none)


def attribute_rows(products: DataFrame, rules: list | None = None, materials: tuple = defaults.MATERIALS, colors: tuple = defaults.COLORS) -> DataFrame:
    """All attributes of every product, from its name alone: one projection, no shuffle.

    confidence is the mean over what was found (an unknown use is general, at a low confidence), attribute_confidence
    maps each found attribute to its own. Null names have only the general use.
    """
    rules = defaults.KEYWORD_RULES if rules is None else rules
    base = products.select("product_id", "product_name", normalized(F.col("product_name")).alias("_n")).withColumn("_w", F.split("_n", " "))
    name, words = F.col("_n"), F.col("_w")
    some = lambda pattern, group: F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))
    unit = some(CAPACITY, 2)
    first = lambda pairs: F.coalesce(*[F.when(F.array_contains(words, k), v) for k, v in pairs], F.lit(None))
    material = first([(k, F.struct(F.lit(m).alias("m"), F.lit(f).alias("f"))) for k, m, f in materials])
    found = base.withColumns({f"_{a}": rule_value(rules, a, name, words) for a in RULED}).withColumns({
        "_material": material, "color": first([(c, F.lit(c)) for c in colors]), "_unit": unit, "size_text": some(SIZE, 0),
        "capacity_value": F.replace(some(CAPACITY, 1), F.lit(","), F.lit(".")).try_cast("double"),
        "mouth_size_mm": F.coalesce(some(MOUTH[0], 1), some(MOUTH[1], 1)).try_cast("double"),
    })
    held = {a: F.col(f"_{a}.confidence") for a in RULED[:5]} | {
        "material": F.when(F.col("_material").isNotNull(), defaults.CONFIDENCE["material"]), "color": F.when(F.col("color").isNotNull(), defaults.CONFIDENCE["color"]),
        "capacity": F.when(F.col("_unit").isNotNull(), MEASURED["capacity"]), "mouth_size": F.when(F.col("mouth_size_mm").isNotNull(), MEASURED["mouth"]),
        "size_text": F.when(F.col("size_text").isNotNull(), MEASURED["size"]), "use_category": F.coalesce("_use_category.confidence", F.lit(defaults.CONFIDENCE["default_use"])),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.round(c, 4).alias("value")) for k, c in held.items()]), lambda e: e["value"].isNotNull())
    mean = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"]) / F.size(entries)
    subtype = F.col("_subtype.value")
    return found.withColumn("_e", entries).select(
        "product_id", "product_name", F.col("_product_type.value").alias("product_type"), subtype.alias("subtype"), F.col("_material.m").alias("material"), "color", "capacity_value",
        F.when(F.col("_unit").isin("LT", "LTR"), "L").when(F.col("_unit") == "G", "GR").otherwise(F.col("_unit")).alias("capacity_unit"), "mouth_size_mm", "size_text",
        F.when(subtype.isin(*defaults.CLOSURES), subtype).alias("closure_type"), F.col("_accessory.value").alias("accessory"), F.col("_shape.value").alias("shape"), F.col("_feature.value").alias("feature"),
        F.coalesce("_use_category.value", F.lit(defaults.DEFAULT_USE)).alias("use_category"), F.col("_material.f").alias("material_family"),
        F.to_json(F.slice(tokens(F.col("product_name")), 1, 8)).alias("keywords"), F.round(mean, 4).alias("confidence"), F.map_from_entries("_e").alias("attribute_confidence"),
    )


def with_activity(attributes: DataFrame, activity: DataFrame) -> DataFrame:
    """attributes with the products' numbers of lines and totals, zero where there are none. activity: product_id, n_sales, n_purchases, sales_total, purchases_total."""
    columns = ("n_sales", "n_purchases", "sales_total", "purchases_total")
    joined = attributes.join(activity.select("product_id", *columns), "product_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def labelled(attributes: DataFrame) -> DataFrame:
    """attributes with capacity and mouth size as texts."""
    return attributes.withColumns({
        "capacity_text": F.when(F.col("capacity_value").isNotNull() & F.col("capacity_unit").isNotNull(), F.concat(plain_number(F.col("capacity_value")), F.upper("capacity_unit"))),
        "mouth_size_text": F.when(F.col("mouth_size_mm").isNotNull(), F.concat(plain_number(F.col("mouth_size_mm")), F.lit("MM"))),
    })


def graph_edges(attributes: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """source, target, relation, weight: an edge for each value of each attribute whose own confidence (the product's, if it has none) is high enough."""
    options = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(relation).alias("relation"), F.col(column).alias("value"), F.coalesce(F.try_element_at("attribute_confidence", F.lit(key)), F.col("confidence")).alias("weight")) for column, kind, relation, key in GRAPH])
    strong = F.filter(options, lambda o: (o["weight"] >= least) & o["value"].isNotNull())
    rows = labelled(attributes).where("product_id is not null and trim(product_id) != ''").select("product_id", F.explode(strong).alias("o"))
    values = rows.select("product_id", "o.*").withColumn("label", F.explode(F.split("value", r"\|"))).withColumn("label", F.trim("label")).where("label != ''")
    target = F.concat(F.col("kind"), F.lit(":"), F.replace(normalized(F.col("label")), F.lit(" "), F.lit("_")))
    return values.select(F.concat(F.lit("PRODUCT:"), F.trim("product_id")).alias("source"), target.alias("target"), "relation", F.round("weight", 4).alias("weight"), "kind", "label")


def graph_nodes(attributes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, node_type, label: all products, and every attribute node once, under its least label."""
    products = attributes.where("product_id is not null and trim(product_id) != ''").select(F.concat(F.lit("PRODUCT:"), F.trim("product_id")).alias("node_id"), F.lit("PRODUCT").alias("node_type"), F.col("product_name").alias("label"))
    return products.unionByName(edges.groupBy(F.col("target").alias("node_id")).agg(F.min("kind").alias("node_type"), F.min("label").alias("label")))


def adjacency_sample(nodes: DataFrame, edges: DataFrame, k: int = 80) -> DataFrame:
    """The first k edges with the labels of both ends."""
    few = edges.orderBy("source", "target").limit(k)
    label = lambda c: nodes.select(F.col("node_id").alias(c), F.col("label").alias(f"{c}_label"))
    return few.select("source", "relation", "target", "weight").join(label("source"), "source").join(label("target"), "target").select("source", "source_label", "relation", "target", "target_label", "weight")


def long_attributes(attributes: DataFrame, columns: tuple[str, ...] = REPORTED) -> DataFrame:
    """product_id, attribute, value (trimmed text, null if empty) of every product and column."""
    texts = attributes.select("product_id", *[F.nullif(F.trim(plain_number(F.col(c)) if dict(attributes.dtypes)[c] == "double" else F.col(c).cast("string")), F.lit("")).alias(c) for c in columns])
    return texts.unpivot("product_id", list(columns), "attribute", "value")


def coverage_report(attributes: DataFrame, k: int = 10) -> DataFrame:
    """attribute, filled, total, coverage, unique_values and the k most frequent values (value=n, by falling n) of each reported attribute."""
    counted = long_attributes(attributes).groupBy("attribute", "value").agg(F.count("*").alias("n"))
    top = F.row_number().over(Window.partitionBy("attribute").orderBy(F.col("value").isNull(), F.col("n").desc(), "value"))
    ranked = counted.withColumn("rank", top)
    shown = F.when((F.col("rank") <= k) & F.col("value").isNotNull(), F.struct("rank", F.concat("value", F.lit("="), F.col("n").cast("string")).alias("t")))
    some = F.when(F.col("value").isNotNull(), F.col("n"))
    out = ranked.groupBy("attribute").agg(F.coalesce(F.sum(some), F.lit(0)).alias("filled"), F.sum("n").alias("total"), F.count("value").alias("unique_values"), F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]), ",").alias("top_values"))
    return out.withColumn("coverage", F.round(F.col("filled") / F.greatest(F.col("total"), F.lit(1)), 4))


def gold_accuracy(attributes: DataFrame, gold: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """How predicted attributes agree with a catalogue that people filled (same columns): accuracy where both have a value, recall of all expected ones."""
    plain = lambda df, name: long_attributes(df, columns).select("product_id", "attribute", F.nullif(normalized(F.col("value")), F.lit("")).alias(name))
    both = plain(attributes, "predicted").join(plain(gold, "expected"), ["product_id", "attribute"])
    filled, same = F.col("predicted").isNotNull() & F.col("expected").isNotNull(), F.col("predicted") == F.col("expected")
    return both.groupBy("attribute").agg(
        F.count("*").alias("overlap_rows"), F.count("expected").alias("expected_filled"), F.count_if(filled).alias("predicted_filled_on_expected"),
        F.round(F.avg(F.when(filled, same.cast("double"))), 4).alias("accuracy_on_both_filled"), F.round(F.count_if(same) / F.greatest(F.count("expected"), F.lit(1)), 4).alias("recall_against_expected"),
    )


def delta_report(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """product_id, attribute, baseline_value, candidate_value, change_type of every attribute that two extractions give differently."""
    side = lambda df, name: long_attributes(df, COMPARED).select("product_id", "attribute", F.coalesce("value", F.lit("")).alias(name))
    both = side(baseline, "baseline_value").join(side(candidate, "candidate_value"), ["product_id", "attribute"]).where("baseline_value != candidate_value")
    return both.withColumn("change_type", F.when(F.col("baseline_value") == "", "filled").when(F.col("candidate_value") == "", "removed").otherwise("changed"))


def review_sample(attributes: DataFrame, k: int = 40) -> DataFrame:
    """The k products that need a look most: without a type, with low confidence, caps with a capacity; then by activity. attributes as with_activity() gives them."""
    reason = F.concat(
        F.when(F.col("product_type").isNull(), "sin_tipo;").otherwise(""), F.when(F.col("confidence") < 0.78, "baja_confianza;").otherwise(""),
        F.when((F.col("product_type") == "tapa") & F.col("capacity_value").isNotNull(), "tapa_con_capacidad;").otherwise(""),
    )
    score = F.col("n_sales") + F.col("n_purchases") + F.abs("sales_total") / 100
    order = [F.col("needs_review_reason").desc(), F.col("activity_score").desc(), F.col("confidence"), F.col("product_id")]
    return attributes.withColumns({"needs_review_reason": reason, "activity_score": score}).orderBy(*order).limit(k).select("product_id", "product_name", "product_type", "confidence", "needs_review_reason", "activity_score")


def unvalidated_sample(attributes: DataFrame, catalogue: DataFrame, k: int = 50) -> DataFrame:
    """The k most active products that the catalogue (product_id) does not have."""
    score = F.col("n_sales") + F.col("n_purchases") + F.abs("sales_total") / 100 + F.abs("purchases_total") / 100
    left = attributes.join(catalogue.select("product_id").distinct(), "product_id", "left_anti").withColumn("activity_score", score)
    return left.orderBy(F.col("activity_score").desc(), "confidence", "product_id").limit(k).select("product_id", "product_name", "confidence", "activity_score")


def description_sample(attributes: DataFrame, k: int = 60, seed: int = 43) -> DataFrame:
    """Up to k different names: half by missing attributes, a quarter by low confidence, a sixth by length, the rest at random (by a hash, so alike on every run)."""
    missing = sum((F.col(c).isNull().cast("int") for c in ("subtype", "accessory", "shape", "feature")), F.lit(0))
    scoped = attributes.select("product_id", "product_name", "confidence", missing.alias("missing"), F.length("product_name").alias("size"), F.xxhash64(F.lit(seed), F.col("product_id")).alias("draw"))
    part = lambda place, n, *order: scoped.orderBy(*order, "product_id").limit(n).select("product_name", F.lit(place).alias("part"), "product_id")
    parts = part(0, k // 2, F.col("missing").desc(), "confidence").union(part(1, k // 4, "confidence")).union(part(2, k // 6, F.col("size").desc())).union(part(3, k, "draw"))
    once = parts.groupBy("product_name").agg(F.min("part").alias("part"), F.min("product_id").alias("product_id"))
    return once.orderBy("part", "product_id").limit(k).select("product_name", F.col("part").cast("long").alias("part"))


def uncovered_tokens(profile: DataFrame, rules: list | None = None, k: int = 50) -> DataFrame:
    """Frequent tokens that no rule names. profile: token, n, n_products."""
    rules = defaults.KEYWORD_RULES if rules is None else rules
    covered = sorted({k for r in rules for k in r[3]} | {m[0] for m in defaults.MATERIALS} | set(defaults.COLORS))
    plain = F.lit(False)
    for p in PLAIN_TOKENS:
        plain = plain | F.col("token").rlike(p)
    left = profile.where(~F.col("token").isin(*covered, *STOP_WORDS) & ~plain & (F.length("token") > 2))
    return left.orderBy(F.col("n").desc(), "token").limit(k)


def top_tokens(products: DataFrame, k: int = 100) -> DataFrame:
    """token, token_count, product_count, product_coverage of the k most frequent words of product names; equal counts by word."""
    words = products.select("product_id", F.explode(tokens(F.col("product_name"))).alias("token"))
    n = products.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    counts = words.groupBy("token").agg(F.count("*").alias("token_count"), F.count_distinct("product_id").alias("product_count")).crossJoin(F.broadcast(n))
    return counts.select("token", "token_count", "product_count", F.round(F.col("product_count") / F.col("n"), 4).alias("product_coverage")).orderBy(F.col("token_count").desc(), "token").limit(k)
