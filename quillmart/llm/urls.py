"""URL filters by a Bloom filter cascade: exact membership of listed keys over the complete key universe of the corpus.

Level 0 holds the listed keys; each further level holds the keys of the other side that the level before lets through, until
none is left. A lookup walks the levels, so it needs no join and errs on no key of the universe.

Keys are rule keys (a host suffix and a path prefix as long as some rule's path) and whole hosts. Listed are the rules and,
as the method's own list, hosts that serve mostly session or tracking copies: at least half of their addresses in the corpus
carry a query or a fragment. Those are blocked when no rule fits.

Rows in: `page_id`, `url`. A null url, or one without `://`, has empty host and path, fits no rule and is allowed. Every row
comes out once, repeated rows too. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

#: Fixed values: (host, path) to verdict.
RULES = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
BITS_PER_KEY, PROBES, LEAST_BITS = 10, 7, 1024
#: Share of keys that a level lets through in error, rounded up.
PASSED = 0.01
#: Bits of one broadcast cascade; if listed keys and false positives of the others need more, keys are split by hash into several cascades, looked up one after the other.
MOST_BITS = 1 << 28
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), _UPPER, _UPPER.lower()), part(2)


def _keys(host: Column, path: Column, rules: dict) -> Column:
    """Every key that a rule could have for this url, then the host's own key."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = sorted({len(p) for _, p in rules})
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    rule_keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host != "", F.concat(rule_keys, F.array(F.concat(F.lit("host:"), host)))).otherwise(F.array().cast("array<string>"))


def _hashes(key: Column) -> tuple[Column, Column]:
    """A start of 48 bits and an odd step of 24, small enough that no sum of them overflows."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 48) - 1)), F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit((1 << 24) - 1)).bitwiseOR(F.lit(1))


def _level(keys: DataFrame, n: int, depth: int) -> tuple[int, np.ndarray]:
    """A Bloom filter of n keys (h1, h2): words of bits are or-ed by Spark, the driver gets one row per used word.

    Sizes differ from level to level, so two keys that fall on the same bits of one level part on another.
    """
    size = (max(LEAST_BITS, n * BITS_PER_KEY) | 1) + 2 * depth
    bit = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: (F.col("h1") + i * F.col("h2")) % F.lit(size)))
    words = keys.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    out = np.zeros(size // 32 + 1, np.uint32)
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return size, out


def _probe(level: tuple[int, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    size, bits = level
    inside = np.ones(len(h1), bool)
    for i in range(PROBES):
        at = (h1 + i * h2) % size
        inside &= (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
    return inside


def member(levels: list[tuple[int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed."""
    out, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    for depth, level in enumerate(levels):
        passed = np.zeros(len(h1), bool)
        passed[open_] = _probe(level, h1[open_], h2[open_])
        out[open_ & ~passed] = depth % 2 == 1
        open_ &= passed
    out[open_] = len(levels) % 2 == 1
    return out


def build_cascade(universe: DataFrame) -> list[tuple[int, np.ndarray]]:
    """universe: distinct (h1, h2, listed), stored. Levels alternate until one side has no false positives left."""
    inside, outside = universe.where("listed"), universe.where("not listed")
    levels: list[tuple[int, np.ndarray]] = []
    while n := inside.count():
        levels.append(level := _level(inside, n, len(levels)))
        shared = universe.sparkSession.sparkContext.broadcast(level)

        def through(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(_probe(shared.value, b.column("h1").to_numpy(), b.column("h2").to_numpy())))

        passed = outside.select("h1", "h2").mapInArrow(through, "h1 long, h2 long")
        inside, outside = stored(passed, "cascade-level"), inside
    return levels


def cascades(listed: int, universe: int, most_bits: int) -> int:
    """How many cascades keep their levels together below most_bits: level 0 has the listed keys, level 1 what it lets through of the others, and so on in turn."""
    needed = (listed + PASSED * (universe - listed)) * BITS_PER_KEY / (1 - PASSED)
    return max(1, -(-int(needed) // most_bits))


def url_filter(pages: DataFrame, rules: dict = RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """`row` (all columns of pages), host, path, rule and verdict of every page."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    keyed = named.withColumn("keys", _keys(F.col("host"), F.col("path"), rules))
    seen = keyed.select(F.explode("keys").alias("key")).distinct()
    tagged = F.col("row.url").rlike("[?#]").cast("long")
    copies = named.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), F.sum(tagged).alias("n_tagged")).where("2 * n_tagged >= n")
    copies = copies.select(F.concat(F.lit("host:"), "host").alias("key"), F.lit(True).alias("copying"))
    listed_rules = [h + p for h, p in rules]
    h1, h2 = _hashes(F.col("key"))
    universe = stored(seen.join(copies, "key", "left").select("key", h1.alias("h1"), h2.alias("h2"), (F.col("key").isin(listed_rules) | F.coalesce("copying", F.lit(False))).alias("listed")), "cascade-universe")

    counts = universe.agg(F.count_if("listed").alias("listed"), F.count("*").alias("all")).first()
    shards = cascades(counts["listed"], counts["all"], most_bits)
    out = keyed.withColumn("listed", F.array().cast("array<boolean>"))
    names = keyed.columns
    for shard in range(shards):
        levels = build_cascade(universe.where(F.pmod("h1", F.lit(shards)) == shard))
        shared = spark.sparkContext.broadcast(levels)

        def look(batches: Iterator[pa.RecordBatch], shard=shard, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, before = b.column("h1"), b.column("listed")
                first, second = (x.flatten().to_numpy() for x in (keys, b.column("h2")))
                found = member(shared.value, first, second) & (first % shards == shard)
                if shard:
                    found |= before.flatten().to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [listed], [*names, "listed"])

        probes = out.select(*names, "listed", F.transform("keys", lambda k: _hashes(k)[0]).alias("h1"), F.transform("keys", lambda k: _hashes(k)[1]).alias("h2"))
        out = probes.mapInArrow(look, StructType([*keyed.schema.fields, *StructType.fromDDL("listed array<boolean>").fields]))
    hits = F.transform(F.filter(F.arrays_zip("keys", "listed"), lambda x: x["listed"]), lambda x: x["keys"])
    fit = F.filter(hits, lambda k: ~k.startswith("host:"))
    rule = F.get(F.sort_array(F.transform(fit, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))), asc=False), 0)["key"]
    verdicts = F.create_map(*[F.lit(x) for h, p in rules for x in (h + p, rules[h, p])])
    own = F.when(F.exists(hits, lambda k: k.startswith("host:")), "block").otherwise("allow")
    judged = out.withColumn("rule", F.when(F.size(fit) > 0, rule))
    return judged.select("row", "host", "path", "rule", F.coalesce(F.try_element_at(verdicts, F.col("rule")), own).alias("verdict"))
