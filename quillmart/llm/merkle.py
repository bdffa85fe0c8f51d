"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Each row is a leaf. The leaves of a group (a source) ascend by their key; runs of 16 nodes become a node until one is left, the
group's subroot, and the subroots make a tree of their own up to the root. Every node of a tree holds the siblings on its way to
its parent. In each round a node takes over the way of the node it points to, so distances to ancestors double, until all point to
the root; the leaves of a run, which share the way of their run, take the last jump together.

No order is kept by one task: rows are sorted by range, a row's place is its place in its range behind the ranges before. Nodes of
levels that are few are broadcast, so that no node near a root is one join key for all below it.

Rows in: the columns of FIELDS, each may be null (a null key comes first, a null group is a group of its own). Rows equal in all
FIELDS are leaves of their own next to each other. Long texts are hashed where they are read and do not travel. Other columns,
whatever their names, are ignored. An empty table has no root and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, stored

#: What a leaf is made of, the column that makes the groups, and the one that orders a group.
FIELDS, GROUP, ORDER = ("doc_id", "source", "lang", "n_chars", "text"), "source", "doc_id"
#: Children of a node, as a power of two.
FAN_BITS = 4
#: A level of at most so many nodes is broadcast: some kilobytes each.
FEW = 1024
#: The tree whose leaves are the subroots.
TOP = -1

_SIDES = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of values, each as its length in bytes, a colon and itself, or - if null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*[part(c.cast("string")) for c in fields]))


def lowered(column: str) -> Column:
    """A-Z to a-z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(column), upper, upper.lower())


def _leaves(docs: DataFrame, tampered: Column, forged: Column) -> DataFrame:
    """grp, key, leaf, forged (the tampered row's leaf, null for others) and a number of its own for each row."""
    text = F.col("text").cast("string")
    made = lambda t: leaf([t if f == "text" else F.col(f) for f in FIELDS])
    return docs.select(F.col(GROUP).cast("string").alias("grp"), F.col(ORDER).alias("key"), made(text).alias("leaf"), F.when(tampered, made(forged)).alias("forged"), F.monotonically_increasing_id().alias("row"))


def _sorted(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (of a stored table, as ranges are found by reading it first) sorted over ranges: `part`, and `at` that rises along the order."""
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return stored(ranged, name).withColumn("part", F.shiftright("at", 33))


def _before(counts: DataFrame, *group: str) -> DataFrame:
    """counts (part, first, n, of each group) with `before`, rows of the group in earlier ranges, and `size`, all its rows. There are as many rows as ranges, for each group that spans them."""
    along = Window.partitionBy(*group)
    earlier = F.sum("n").over(along.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*group, "part", "first", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("n").over(along).alias("size"))


def _placed_groups(groups: DataFrame) -> DataFrame:
    """grp, tree: the place of each group among the sorted ones."""
    rows = _sorted(stored(groups, "merkle-groups"), ["grp"], "merkle-groups")
    before = _before(rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    return rows.join(F.broadcast(before), "part").select("grp", (F.col("at") - F.col("first") + F.col("before")).alias("tree"))


def _placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Leaves with tree, place and the size of their tree; the number of trees."""
    rows = _sorted(leaves, ["grp", "key", "leaf", "row"], "merkle-sorted")
    before = stored(_before(rows.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "grp"), "merkle-ranges")
    trees = stored(_placed_groups(before.select("grp").distinct()), "merkle-trees")
    ranges = stored(before.join(trees.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).drop("g"), "merkle-ranges").withColumnsRenamed({"grp": "g", "part": "p"})
    found = rows.join(ranges, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return found.select("tree", "size", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "key", "leaf", "forged"), trees.count()


def _height(size: Column) -> Column:
    """Levels above the leaves: hexadecimal digits of the last place."""
    return F.when(size > 1, F.length(F.hex(size - 1))).otherwise(0)


def _parents(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """tree, size, pos of each run of nodes and its children in order."""
    kids = F.array_sort(F.collect_list(F.struct("pos", *payload)))
    return nodes.groupBy("tree", "size", F.shiftright("pos", FAN_BITS).alias("up")).agg(kids.alias("kids")).withColumnRenamed("up", "pos")


def _joined(kids: Column, of: str) -> Column:
    return F.array_join(F.transform(kids, lambda k: k[of]), "")


def _sides(at: Column, of: str) -> Column:
    """The siblings before and after place `at` (from 0) of `kids`."""
    return F.struct(_joined(F.slice("kids", F.lit(1), at), of).alias("l"), _joined(F.slice("kids", at + 2, F.size("kids")), of).alias("r"))


def _grown(nodes: DataFrame, level: int, height: int) -> tuple[DataFrame | None, DataFrame]:
    """Ways from the nodes of trees to their parents, from a level upwards, and the last node of each tree (tree, level, digest).

    nodes: tree, size, pos, digest.
    """
    ways, ends = None, nodes.where(_height(F.col("size")) == level).select("tree", F.lit(level).alias("level"), "digest")
    while level < height:
        runs = stored(_parents(nodes.where(_height(F.col("size")) > level), ["digest"]), "merkle-runs")
        each = runs.select("tree", F.posexplode("kids").alias("i", "kid"), "kids", F.col("pos").alias("to_pos"))
        way = each.select("tree", F.lit(level).alias("level"), F.col("kid.pos").alias("pos"), F.col("tree").alias("to_tree"), F.lit(level + 1).alias("to_level"), "to_pos", F.array(_sides(F.col("i"), "digest")).alias("sides"), F.lit(None).cast("string").alias("subroot"))
        ways = way if ways is None else ways.unionByName(way)
        level += 1
        nodes = runs.select("tree", "size", "pos", digest(_joined(F.col("kids"), "digest")).alias("digest"))
        ends = ends.unionByName(nodes.where(_height(F.col("size")) == level).select("tree", F.lit(level).alias("level"), "digest"))
    return ways, ends


def _jumped(ways: DataFrame, depth: int) -> DataFrame:
    """Ways whose distance doubles until each ends at the root."""
    reach = 1
    while reach < depth:
        # the number of nodes of each level; there are as many rows as levels
        few = [r.name for r in ways.groupBy(_level_name("tree", "level").alias("name")).count().where(F.col("count") <= FEW).collect()]
        near = _level_name("to_tree", "to_level").isin(few)
        target = ways.select(F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("pos").alias("to_pos"), F.struct("to_tree", "to_level", "to_pos", "sides", "subroot").alias("on"))
        is_few = _level_name("to_tree", "to_level").isin(few)
        hop = lambda rows, to: rows.join(to, ["to_tree", "to_level", "to_pos"], "left").select("tree", "level", "pos", *[F.coalesce(F.col("on")[c], F.col(c)).alias(c) for c in ("to_tree", "to_level", "to_pos")], F.concat("sides", F.coalesce(F.col("on.sides"), F.lit([]).cast(_SIDES))).alias("sides"), F.coalesce("subroot", F.col("on.subroot")).alias("subroot"))
        jumped = hop(ways.where(near), F.broadcast(target.where(is_few))).unionByName(hop(ways.where(~near), target.where(~is_few)))
        ways, reach = stored(jumped, "merkle-ways"), reach * 2
    return ways


def _level_name(tree: str, level: str) -> Column:
    return F.concat(F.when(F.col(tree) == TOP, "top").otherwise("group"), F.col(level).cast("string"))


def proofs(docs: DataFrame, tampered: Column | None = None, forged: Column | None = None) -> DataFrame:
    """key, leaf, forged, subroot, root and `sides` of every row: per level up to the root the joined digests of the siblings before (l) and after (r) it.

    Where `tampered` holds, `forged` is the leaf that the row would have with the text `forged`; else null.
    """
    made = stored(_leaves(docs, F.lit(False) if tampered is None else tampered, F.col("text") if forged is None else forged), "merkle-leaves")
    placed, n_trees = _placed(made)
    runs = stored(_parents(placed, ["key", "leaf", "forged"]), "merkle-leaf-runs")
    dropped(made)
    height = runs.agg(F.coalesce(F.max(_height(F.col("size"))), F.lit(0))).first()[0]
    if not n_trees:
        return runs.selectExpr("kids[0].key key", "kids[0].leaf leaf", "kids[0].forged forged", "cast(null as string) subroot", "cast(null as string) root", f"cast(array() as {_SIDES}) sides")
    alone = F.col("size") == 1
    lone = runs.where(alone).select("tree", F.lit(0).alias("level"), F.col("kids")[0]["leaf"].alias("digest"))
    first = runs.where(~alone).select("tree", "size", "pos", digest(_joined(F.col("kids"), "leaf")).alias("digest"))
    ways, ends = _grown(first, 1, height)
    subroots = stored(lone.unionByName(ends), "merkle-subroots")
    top_height = len(f"{n_trees - 1:x}") if n_trees > 1 else 0
    top_ways, top_end = _grown(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("size"), F.col("tree").alias("pos"), "digest"), 0, top_height)
    root = top_end.select("digest").first()[0]
    if top_ways is not None:
        of = subroots.select(F.col("tree").alias("pos"), F.col("level").alias("own_level"), "digest")
        leave = top_ways.where("level = 0").join(of, "pos").select(F.col("pos").alias("tree"), F.col("own_level").alias("level"), F.lit(0).cast("long").alias("pos"), "to_tree", "to_level", "to_pos", "sides", F.col("digest").alias("subroot"))
        upper = leave.unionByName(top_ways.where("level > 0"))
        ways = upper if ways is None else ways.unionByName(upper)
    level = F.when(alone, 0).otherwise(1)
    each = runs.select("tree", level.alias("level"), "pos", "kids")
    if ways is None:
        each = each.withColumns({"sides": F.lit([]).cast(_SIDES), "subroot": F.lit(None).cast("string")})
    else:
        each = each.join(_jumped(stored(ways, "merkle-ways"), height + top_height).select("tree", "level", "pos", "sides", "subroot"), ["tree", "level", "pos"], "left")
    rows = each.select("level", "kids", F.posexplode("kids").alias("i", "kid"), F.coalesce("sides", F.lit([]).cast(_SIDES)).alias("rest"), F.coalesce("subroot", F.lit(root)).alias("subroot"))
    own = F.when(F.col("level") == 1, F.array(_sides(F.col("i"), "leaf"))).otherwise(F.lit([]).cast(_SIDES))
    return rows.select("kid.key", "kid.leaf", "kid.forged", "subroot", F.lit(root).alias("root"), F.concat(own, "rest").alias("sides"))


def folded(start: Column) -> Column:
    """The root that a leaf leads to along `sides`."""
    return F.aggregate("sides", start, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


def verify(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of proofs(): the forged leaf, if there is one, is folded along the row's own siblings."""
    proof = digest(F.array_join(F.transform("sides", lambda s: F.concat(s["l"], s["r"])), ""))
    seen = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("forged", "leaf")).alias("folded_root"))
    return seen.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """verify() where texts of rows whose doc_id has a checksum (CRC-32 of its decimals) that 5 divides are lower-cased."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return verify(proofs(docs, F.coalesce(chosen, F.lit(False)), lowered("text")))
