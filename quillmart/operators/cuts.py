"""Largest flow and least cut of one network that all orders and suppliers share, as tables.

The network runs from the source over suppliers (their capacity) and offers (units of a product at a supplier) to products and their
demand. Demand is pushed from the products towards the source: distances to the source over arcs with room are found by frontier
rounds, then all nodes push what they hold one step nearer, the farthest first; what a node cannot pass on waits for new
distances and may go back where it came from. It ends when nothing that is held can reach the source. Then the nodes that could still reach the
source are the least cut's side of the source, the same for every largest flow. Each distance and each step is a join and a group-by over
arcs; rounds are written to the shared folder. Units are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmart.plans.canonical import stored

SOURCE = "SOURCE"


def _network(demand: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (a, b, room) against the direction of supply with their reverses, and what products hold (node, held). Products that nobody offers and null or no units are left out."""
    asked = demand.where("ordered > 0").groupBy("product_id").agg(F.sum("ordered").cast("long").alias("ordered"))
    offers = options.where("product_id is not null and supplier is not null").groupBy("product_id", "supplier").agg(F.max("capacity_units").cast("long").alias("units"), F.max("supplier_capacity").cast("long").alias("capacity"))
    offers = stored(offers.join(asked.select("product_id"), "product_id", "left_semi"), "cut-offers")
    p, s = F.concat(F.lit("P:"), "product_id"), F.concat(F.lit("S:"), "supplier")
    room = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    there = offers.select(p.alias("a"), s.alias("b"), room("units").alias("room")).unionByName(offers.groupBy("supplier").agg(F.max("capacity").alias("capacity")).select(s.alias("a"), F.lit(SOURCE).alias("b"), room("capacity").alias("room")))
    arcs = there.unionByName(there.where(F.col("b") != SOURCE).select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).cast("long").alias("room")))
    held = asked.join(offers.select("product_id").distinct(), "product_id", "left_semi").select(p.alias("node"), F.col("ordered").alias("held"))
    return stored(arcs, "cut-arcs"), stored(held, "cut-held")


def _distances(arcs: DataFrame) -> tuple[DataFrame, int]:
    """node, distance to the source over arcs with room, and the largest distance."""
    level = arcs.sparkSession.range(1).select(F.lit(SOURCE).alias("node"), F.lit(0).alias("distance"))
    known, depth = level, 0
    while True:
        near = arcs.where("room > 0").join(level.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node")).distinct()
        level = stored(near.join(known.select("node"), "node", "left_anti").withColumn("distance", F.lit(depth + 1)), "cut-level")
        if level.isEmpty():
            return known, depth
        known, depth = stored(known.unionByName(level), "cut-distances"), depth + 1


def _wave(arcs: DataFrame, held: DataFrame, distances: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Arcs and holdings after every node has pushed what it can one step nearer to the source, from the farthest on."""
    at = distances.select(F.col("node").alias("b"), F.col("distance").alias("d_b"))
    down = stored(arcs.where("room > 0").join(distances.select(F.col("node").alias("a"), "distance"), "a").join(at, "b").where("d_b = distance - 1").select("a", "b", "room", "distance"), "cut-down")
    before = F.coalesce(F.sum("room").over(Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved, all_moved = None, None
    for d in range(depth, 0, -1):
        here = held if moved is None else held.unionByName(moved.select(F.col("b").alias("node"), F.col("units").alias("held")))
        holding = here.groupBy(F.col("node").alias("a")).agg(F.sum("held").alias("held")).where("held > 0")
        units = F.greatest(F.lit(0), F.least("room", F.col("held") - F.col("before"))).cast("long")
        moved = stored(down.where(F.col("distance") == d).join(holding, "a").withColumn("before", before).select("a", "b", units.alias("units")).where("units > 0"), "cut-moved")
        all_moved = moved if all_moved is None else all_moved.unionByName(moved)
    change = all_moved.select("a", "b", (-F.col("units")).alias("room")).unionByName(all_moved.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("units").alias("room"))).where(F.col("a") != SOURCE)
    arcs = stored(arcs.unionByName(change).groupBy("a", "b").agg(F.sum("room").alias("room")), "cut-arcs")
    passed = all_moved.select(F.col("a").alias("node"), (-F.col("units")).alias("held")).unionByName(all_moved.select(F.col("b").alias("node"), F.col("units").alias("held")))
    return arcs, stored(held.unionByName(passed).groupBy("node").agg(F.sum("held").alias("held")).where("held > 0"), "cut-held")


def shared_cut(demand: DataFrame, options: DataFrame) -> DataFrame:
    """kind, source, target, capacity of the arcs of the least cut nearest to the source: SOURCE->SUPPLIER, SUPPLIER->PRODUCT and PRODUCT->SINK. Their capacities add up to the largest flow.

    demand: product_id, ordered. options: product_id, supplier, capacity_units, supplier_capacity (per supplier, over all products).
    """
    first, held = _network(demand, options)
    wanted, arcs = held, first
    while True:
        distances, depth = _distances(arcs)
        waiting = held.where(F.col("node") != SOURCE).join(distances.select("node"), "node", "left_semi")
        if waiting.isEmpty():
            break
        arcs, held = _wave(arcs, held, distances, depth)
    side = distances.select("node")
    name = lambda c: F.expr(f"substr({c}, 3)")
    out = lambda df, kind, a, b, n: df.select(F.lit(kind).alias("kind"), a.alias("source"), b.alias("target"), n.cast("long").alias("capacity")).where("capacity > 0")
    suppliers = first.where(F.col("b") == SOURCE).join(side.withColumnRenamed("node", "a"), "a", "left_anti")
    offers = first.where("a like 'P:%'").join(side.withColumnRenamed("node", "b"), "b", "left_semi").join(side.withColumnRenamed("node", "a"), "a", "left_anti")
    products = wanted.join(side, "node", "left_semi")
    cut = out(suppliers, "SOURCE->SUPPLIER", F.lit(SOURCE), name("a"), F.col("room")).unionByName(out(offers, "SUPPLIER->PRODUCT", name("b"), name("a"), F.col("room")))
    return cut.unionByName(out(products, "PRODUCT->SINK", name("node"), F.lit("SINK"), F.col("held")))


def shared_flow(demand: DataFrame, options: DataFrame, cut: DataFrame) -> DataFrame:
    """One row: products and suppliers of the network, total_demand, max_flow, coverage, and how many suppliers the cut saturates."""
    asked = demand.where("ordered > 0").groupBy("product_id").agg(F.sum("ordered").alias("ordered")).join(options.select("product_id").distinct(), "product_id", "left_semi")
    offered = options.join(asked.select("product_id"), "product_id", "left_semi").agg(F.count_distinct("supplier").alias("suppliers"))
    flow = cut.agg(F.coalesce(F.sum("capacity"), F.lit(0)).cast("long").alias("max_flow"), F.count_if(F.col("kind") == "SOURCE->SUPPLIER").alias("saturated_suppliers"))
    row = asked.agg(F.count("*").alias("products"), F.coalesce(F.sum("ordered"), F.lit(0)).cast("long").alias("total_demand")).crossJoin(offered).crossJoin(flow)
    return row.withColumn("coverage", F.round(F.when(F.col("total_demand") > 0, F.col("max_flow") / F.col("total_demand")).otherwise(0.0), 4))
