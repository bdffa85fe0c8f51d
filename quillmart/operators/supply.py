"""Supply options, offers and capacity-constrained allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily_capacity(purchases: DataFrame) -> DataFrame:
    """The most units that a supplier delivered on one day."""
    days = purchases.where("is_active").groupBy("supplier", "date").agg(F.sum("quantity").alias("units"))
    return days.groupBy("supplier").agg(F.max("units").alias("capacity"))


def supply_options(purchases: DataFrame) -> DataFrame:
    valid = purchases.where("is_active and quantity > 0 and unit_cost > 0")
    options = valid.groupBy("product_id", "supplier").agg(
        F.min("unit_cost").alias("unit_cost"), F.sum("unit_cost").alias("cost_sum"), F.max("quantity").alias("capacity_units"), F.count("*").alias("n_lines"), F.max("date").alias("last_purchase"), F.min("delivery_days").cast("long").alias("delivery_days")
    )
    return options.join(daily_capacity(purchases), "supplier", "left").withColumnRenamed("capacity", "supplier_capacity")


def offer_candidates(options: DataFrame) -> DataFrame:
    """Options of products with two suppliers or more, against the median of their least costs."""
    reference = options.groupBy("product_id").agg(F.median("unit_cost").alias("reference_cost"), F.count_distinct("supplier").alias("n_suppliers")).where("n_suppliers > 1")
    saving = F.col("reference_cost") - F.col("unit_cost")
    scenario = F.when(saving > 0, "OFFER").when(saving < 0, "EXPENSIVE").otherwise("REFERENCE")
    return options.join(reference, "product_id").select("product_id", "supplier", "unit_cost", "reference_cost", "n_suppliers", saving.alias("saving"), (F.col("unit_cost") - F.col("reference_cost")).alias("edge_weight"), scenario.alias("scenario"))


def savings(candidates: DataFrame) -> DataFrame:
    """Offer candidates with the saving as a share of the reference cost and whether it is one; a reference cost of 0 has no share and is left out."""
    negative = F.col("edge_weight") < 0
    kind = F.when(negative, "historical_saving").otherwise("at_or_above_reference")
    return candidates.where("reference_cost > 0").select("product_id", "supplier", "unit_cost", "reference_cost", "edge_weight", "saving", F.round(F.col("saving") / F.col("reference_cost"), 6).alias("saving_pct"), negative.alias("is_negative_edge"), kind.alias("scenario_type"))


def best_offers(candidates: DataFrame) -> DataFrame:
    """The least edge weight of each product: the shortest path source, product, option, sink of the offer network."""
    best = F.min(F.struct("edge_weight", "supplier", "unit_cost")).alias("best")
    return candidates.groupBy("product_id").agg(best).select("product_id", "best.supplier", "best.edge_weight", "best.unit_cost")


def allocate(options: DataFrame, ordered: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Split each product's ordered units over its options in the given order, each up to its capacity."""
    along = Window.partitionBy("product_id").orderBy(*by, "supplier").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("capacity_units").over(along), F.lit(0))
    units = F.greatest(F.lit(0), F.least("capacity_units", F.col("ordered") - taken))
    split = options.join(ordered, "product_id").withColumn("units", units).where("units > 0")
    return split.select("product_id", "supplier", "units", "unit_cost", "delivery_days", (F.col("units") * F.col("unit_cost")).alias("cost"))


def flow_capacity_violations(split: DataFrame, options: DataFrame) -> DataFrame:
    """Suppliers that a product-by-product split asks for more than their daily capacity."""
    capacity = options.select("supplier", "supplier_capacity").distinct()
    return split.groupBy("supplier").agg(F.sum("units").alias("assigned"), F.sum("cost").alias("cost")).join(capacity, "supplier").select("supplier", "assigned", "cost", "supplier_capacity", (F.col("assigned") > F.col("supplier_capacity")).alias("violated"))
