"""N-gram Jaccard join by parity sketches: documents whose sets of five-word shingles overlap by 75 of 100 or more.

Sets of a and b shingles with that overlap differ in at most D = (a + b) / 7 shingles. Per size band the space of shingle hashes
is cut into pieces, and a piece's parity sketch is the XOR of the hashes in it: equal pieces give equal sketches, and the number
of unequal ones is a lower bound of the symmetric difference. So of the first D + 1 pieces that are not empty in a set at least
one agrees with the partner's (a difference that fills a piece empty on the other side is spent on that piece), and it is among
the partner's first D + 1 too. Each band [2^g, 2^(g+1)) of the smaller set has 2^g pieces; a set also takes part in the band
below where its smallest partners lie. A set with fewer filled pieces than that (small sets) also keys its D + 1 smallest single
shingles; if only one side is short the other side's pieces suffice, and if both are, the single shingles do.

Any order of the pieces will do if all sets keep it, so shingles that very many documents share get pieces of their own, which
come last: a document that is not mostly made of them is never looked up by them.

Equal keys only suggest pairs, and what is asked for is which documents hang together, so pairs are tried in three rounds and only
between documents that no earlier round has joined:
1. Each key of many sets has a leader, the member that meets most others in all its keys; every member is tried with it.
2. The few sets of a small key are paired. In a large key that round 1 left in pieces, each member outside the leader's piece is
   set against all the others by its bit sketch and tried with the nearest one.
3. A member for which round 2 found more than one near sketch in a key, and that is still outside, has all near sketches of its keys
   gathered under one leader of its keys. Each of those sets is brought once for a block of such members and compared exactly.
A large group of near copies is therefore done after one pass over its rows; only members that its leader does not reach meet all
others, by sketch, in blocks of bounded size. Sketches have two to four bits a shingle, and pairs whose Hamming distance is above
(a + b) / 7 are out; the rest is verified on the sets themselves. Nothing is sampled or capped.

Rows in: `doc_id`, `text`. Null and blank texts have an empty set, link with nothing and are their own component. Fewer than five
words count as one shingle. Rows with equal sets stand as one class, so copies are not paired. Null doc_ids are never a
component's name unless nobody else is in it. Other columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Words, as_bytes, components, dropped, gram_hashes, mix, row_key, row_seed, steps, stored

SHINGLE = 5
#: Sketches of at most so many sets, or of so many shingles, are set against each other in one task.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 16_000_000
#: Sets, or shingles of sets, that are compared exactly with as many others in one task.
EXACT_SETS, EXACT_SHINGLES = 1024, 1_000_000
#: Partners, and shingles of partners, that one set is verified against in one task.
PARTNERS, PARTNER_SHINGLES = 256, 4_000_000
#: Shingles in more than this share of all documents have pieces of their own. There are at most (mean set size) / share of them.
HOT_SHARE = 0.001
#: A key with so many rows or fewer pairs its sets directly.
SMALL_KEY = 8
#: A batch of documents reports shingles that so many of its documents hold.
HOT_IN_BATCH = 3


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts, SPACE, True)
    grams = gram_hashes(words.hashes, SHINGLE)
    out = []
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if high - low >= SHINGLE:
            found = np.sort(grams[low : high - SHINGLE + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        else:
            out.append(gram_hashes(words.hashes[low:high], high - low) if high > low else grams[:0])
    return out


def set_name(found: np.ndarray, seed: int = 0) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(found + np.uint64(seed)).sum() + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def _need(smaller: int, larger: int) -> int:
    return (smaller + larger) // 7 + 1


def keys(found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Parity sketches of the pieces, and single shingles where pieces fall short, that this set is looked up by; hot: sorted shingles whose pieces come last."""
    n = len(found)
    common = np.zeros(n, bool)
    if len(hot):
        common = hot[np.minimum(np.searchsorted(hot, found), len(hot) - 1)] == found
        found = np.concatenate([found[~common], found[common]])
        common = np.sort(common)
    band = n.bit_length() - 1
    bands = [(band, _need(n, 4 * n // 3))]
    if band and 3 * n <= 4 * ((1 << band) - 1):
        bands.append((band - 1, _need((1 << band) - 1, n)))
    scrambled, out, short = mix(found), [], False
    for g, need in bands:
        piece = (found >> np.uint64(64 - g) if g else np.zeros(n, np.uint64)) | (common.astype(np.uint64) << np.uint64(40))
        starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        short |= len(starts) < need
        ends = starts[need] if len(starts) > need else n
        starts = starts[:need]
        sketch = np.bitwise_xor.reduceat(scrambled[:ends], starts)
        with np.errstate(over="ignore"):
            out.append(mix(sketch + np.uint64(g + 1)) ^ mix(piece[starts] * np.uint64(64) + np.uint64(g)))
    if short:
        out.append(mix(found[: bands[0][1]] ^ np.uint64(0x5BD1E995)))
    return np.concatenate(out)


def _classer(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = shingle_sets(as_bytes(batch.column("text")))
            names, others = ([set_name(s, x) if len(s) else None for s in sets] for x in (seed, ~seed & 0xFFFFFFFF))
            columns = [batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array(others, pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_shingles", "class", "other", "sketch"])

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        flat = np.concatenate(shingle_sets(as_bytes(batch.column("text"))))
        found, n = np.unique(flat, return_counts=True)
        chosen = n >= HOT_IN_BATCH
        yield pa.RecordBatch.from_arrays([pa.array(found[chosen].view(np.int64)), pa.array(n[chosen])], ["shingle", "n"])


def hot_shingles(texts: DataFrame, total: int | None = None) -> np.ndarray:
    """Sorted hashes of shingles that a share of all documents (total, if counted before) holds; batches report them and the reports add up. Only the order of pieces depends on this."""
    total = texts.count() if total is None else total
    seen = texts.select("text").mapInArrow(_frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    chosen = seen.where(F.col("n") > HOT_SHARE * total).select("shingle")
    return np.sort(np.array([r[0] for r in chosen.toLocalIterator()], np.int64).view(np.uint64))


def _keyer(hot, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = {set_name(s, seed): s for s in shingle_sets(as_bytes(batch.column("text"))) if len(s)}
            if sets:
                found = [keys(s, hot.value) for s in sets.values()]
                names = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(k) for k in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(names)], ["key", "class"])

    return run


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity bit sketch: each shingle flips one of 2^k bits, two to four bits a shingle. Its halves fold into the next smaller one by XOR."""
    k = max(6, (len(found) - 1).bit_length() + 1 if len(found) else 0)
    flips = np.bincount((mix(found ^ np.uint64(0xA5A5A5A5)) & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch of `words` 64-bit words: both halves laid over each other."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches are near enough."""
    for batch in batches:
        ones, twos = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("sketch_a", "sketch_b"))
        far = np.fromiter((int(np.bitwise_count(folded(x, len(y)) ^ folded(y, len(x))).sum()) for x, y in zip(ones, twos, strict=True)), np.int64, len(ones))
        near = 7 * far <= batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))


def _sketch_hits(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Asking members of a task (places), the others, which of those sizes, pieces and sketches allow, and how far they are (times 7, over both sizes)."""
    labels, sizes, asks = (rows.column(c).to_numpy() for c in ("label", "n", "asks"))
    bits = [np.frombuffer(x, np.uint64) for x in rows.column("sketch").to_pylist()]
    words = min(map(len, bits))
    table = np.array([folded(x, words) for x in bits])
    asking, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    chunk = max(1, 4_000_000 // max(1, len(others) * words))
    for i in range(0, len(asking) if len(others) else 0, chunk):
        mine = asking[i : i + chunk]
        far = 7 * np.bitwise_count(table[mine, None, :] ^ table[None, others, :]).sum(axis=2, dtype=np.int64)
        a, b = sizes[mine, None], sizes[None, others]
        near = (far <= a + b) & (4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (labels[mine, None] != labels[None, others])
        yield mine, others, near, far / (a + b)


def _nearest(key: tuple, rows: pa.Table) -> pa.Table:
    """For each asking member of one task of a large key the nearest other, and whether there are more."""
    names = rows.column("class").to_numpy()
    ones, twos, more = [names[:0]], [names[:0]], [np.empty(0, bool)]
    for mine, others, near, far in _sketch_hits(rows):
        n = near.sum(axis=1)
        found = np.flatnonzero(n)
        best = np.where(near, far, 2.0).argmin(axis=1)[found]
        ones.append(names[others[best]])
        twos.append(names[mine[found]])
        more.append(n[found] > 1)
    a, b, more = map(np.concatenate, (ones, twos, more))
    return pa.table({"key": pa.array([key[0].as_py()] * len(a), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "more": pa.array(more)})


def _met(key: tuple, rows: pa.Table) -> pa.Table:
    """Asking members of one task of a large key, and all others near one of them, each under the asking members' homes."""
    names, homes = rows.column("class").to_numpy(), rows.column("home").fill_null(0).to_numpy()
    out: list[tuple[np.ndarray, ...]] = [(homes[:0], names[:0], np.empty(0, bool))]
    for mine, others, near, _ in _sketch_hits(rows):
        mine, near = mine[near.any(axis=1)], near[near.any(axis=1)]
        for home in np.unique(homes[mine]):
            own = homes[mine] == home
            for who, asks in ((mine[own], True), (others[near[own].any(axis=0)], False)):
                out.append((np.full(len(who), home), names[who], np.full(len(who), asks)))
    home, name, asks = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"home": pa.array(home, pa.int64()), "class": pa.array(name, pa.int64()), "asks": pa.array(asks)})


def _all_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links of the asking members of one task, one into each other piece: by their sets where sketches allow."""
    names, labels = rows.column("class").to_numpy(), rows.column("label").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    links = []
    for mine, others, near, _ in _sketch_hits(rows):
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = int(mine[i]), int(others[j])
            if near[i, j] and overlap_enough(sets[x], sets[y]):
                links.append((int(names[y]), int(names[x])))
                near[i, labels[others] == labels[y]] = False
    columns = list(zip(*links, strict=True)) if links else [[], []]
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})


def overlap_enough(one: np.ndarray, two: np.ndarray) -> bool:
    small, large = (one, two) if len(one) < len(two) else (two, one)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= 75 * (len(one) + len(two) - both)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        sets = [s.tobytes() for s in shingle_sets(as_bytes(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("asked"), pa.array(sets, pa.binary())], ["class", "asked", "shingles"])


def _linked(key: tuple, rows: pa.Table) -> pa.Table:
    """Those of a task's sets that overlap enough with the set of the row that owns the task."""
    owns = rows.column("owns").to_pylist()
    names, sets = rows.column("class").to_pylist(), [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    one = sets[owns.index(True)]
    out = [name for name, two, own in zip(names, sets, owns, strict=True) if not own and overlap_enough(one, two)]
    return pa.table({"a": pa.array([key[0].as_py()] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})


_ASKED = "array<struct<a:bigint,task:bigint,owns:boolean>>"
_PACKED = f"class long, asked {_ASKED}, shingles binary"


def verified(texts: DataFrame, holders: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that link. A set with many partners is brought to several tasks, each of bounded size."""
    sized = pairs.join(holders.select(F.col("class").alias("b"), "n"), "b")
    tasks = sized.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / PARTNERS), F.ceil(F.sum("n") / PARTNER_SHINGLES)).alias("tasks"))
    placed = pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).alias("task"))
    asked = placed.select(F.col("b").alias("class"), F.struct("a", "task", F.lit(False).alias("owns")).alias("ask"))
    owners = placed.select(F.col("a").alias("class"), F.struct("a", "task", F.lit(True).alias("owns")).alias("ask")).distinct()
    wanted = asked.union(owners).groupBy("class").agg(F.collect_list("ask").alias("asked")).join(holders.select("class", "row"), "class")
    held = texts.join(wanted, "row").dropDuplicates(["row"]).select("class", "asked", "text")
    packed = held.mapInArrow(_packed, _PACKED)
    return packed.select("class", F.explode("asked").alias("ask"), "shingles").select("class", "ask.*", "shingles").groupBy("a", "task").applyInArrow(_linked, "a long, b long")


def _near(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different pieces that sizes and sketches allow; sides: class, label, n, sketch."""
    side = lambda c: sides.select(F.col("class").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("label", "n", "sketch")))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where("label_a != label_b and 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    return sized.mapInArrow(_near_pairs, "a long, b long")


def _tasks(members: DataFrame, by: str, sets: int, shingles: int) -> DataFrame:
    """by, x, y, class, asks: every block of asking members of a group meets every block of answering ones in the task (by, x, y). members: by, class, n, asks, answers."""
    members = stored(members, "jaccard-members")
    blocks = lambda which: F.greatest(F.ceil(F.count_if(which) / sets), F.ceil(F.coalesce(F.sum(F.when(F.col(which), F.col("n"))), F.lit(0)) / shingles))
    open_ = stored(members.groupBy(by).agg(blocks("asks").alias("asking"), blocks("answers").alias("all")).where("asking > 0"), "jaccard-open")
    placed = members.join(open_, by).withColumn("own", F.xxhash64("class"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    answers = placed.where("answers").select(by, "class", F.lit(False).alias("asks"), F.explode(upto("asking")).alias("x"), F.pmod("own", "all").alias("y"))
    asks = placed.where("asks").select(by, "class", "asks", F.pmod("own", "asking").alias("x"), F.explode(upto("all")).alias("y"))
    return answers.union(asks)


def _dealt(large: DataFrame, leaders: DataFrame, sides: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """Tasks of large keys that are in pieces: members outside the leader's piece ask (only those in `asking`, if given), all members answer. large: key, class; leaders: key, leader."""
    named = large.select("key", "class").join(sides.select("class", "label", "n"), "class").join(leaders.join(sides.select(F.col("class").alias("leader"), F.col("label").alias("lead")), "leader").select("key", "lead"), "key")
    named = named.withColumn("asks", F.col("label") != F.col("lead"))
    if asking is not None:
        named = named.join(asking.select("key").distinct(), "key", "left_semi").join(asking.withColumn("asked", F.lit(True)), ["key", "class"], "left").withColumn("asks", F.col("asks") & F.coalesce("asked", F.lit(False)))
    return _tasks(named.withColumn("answers", F.lit(True)), "key", BLOCK_SETS, BLOCK_SHINGLES)


def near_duplicates(docs: DataFrame, seed: int | None = None) -> DataFrame:
    """row (row_key of doc_id and text under the seed, or one that row_seed() finds), doc_id, n_shingles, component_id and group (null for empty sets) of every row."""
    seed = row_seed(docs) if seed is None else seed
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(seed).alias("row"))
    for naming in itertools.count():
        rows = stored(texts.mapInArrow(_classer(naming), "doc_id long, row long, n_shingles long, class long, other long, sketch binary"), "jaccard-classes")
        held = rows.where("class is not null").groupBy("class").agg(F.min("row").alias("row"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"), F.min("doc_id").alias("least_id"), (F.min("other") != F.max("other")).alias("mixed"))
        holders = stored(held, "jaccard-holders")
        if holders.where("mixed").isEmpty():
            break  # no name stands for two sets

    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(texts))
    keyed = texts.select("text").mapInArrow(_keyer(hot, naming), "key long, class long")
    counted = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    shared = stored(counted, "jaccard-shared")
    large = shared.where(f"n > {SMALL_KEY}").select("key", "class", "n").distinct()

    met = large.groupBy("class").agg(F.sum("n").alias("met"))
    leaders = stored(large.join(met, "class").groupBy("key").agg(F.max(F.struct("met", "class"))["class"].alias("leader"), F.count("*").alias("size")), "jaccard-leaders")
    sides = holders.select("class", F.col("class").alias("label"), "n", "sketch")
    led = large.join(leaders, "key").select(F.col("leader").alias("a"), F.col("class").alias("b")).where("a != b").distinct()
    links = verified(texts, holders, stored(_near(led, sides), "jaccard-led"))
    labels = _joined(holders.select("class", F.col("class").alias("label")), links)

    few = shared.where(f"n <= {SMALL_KEY}").groupBy("key").agg(F.sort_array(F.collect_set("class")).alias("set")).where(F.size("set") > 1).select("set").distinct()
    upper = few.select("set", F.posexplode("set").alias("i", "a"))
    pairs = upper.select("a", F.explode(F.slice("set", F.col("i") + 2, F.size("set"))).alias("b")).distinct()
    sides = holders.drop("row", "least_id", "mixed").join(labels, "class")
    nearest = _dealt(large, leaders, sides).join(sides, "class").groupBy("key", "x", "y").applyInArrow(_nearest, "key long, a long, b long, more boolean")
    nearest = stored(nearest, "jaccard-nearest")
    tried = stored(_near(pairs, sides).union(nearest.select("a", "b")).distinct(), "jaccard-tried")
    labels = _joined(labels, verified(texts, holders, tried))

    sides = holders.drop("row", "least_id", "mixed").join(labels, "class")
    asking = stored(nearest.where("more").select("key", F.col("b").alias("class")).distinct(), "jaccard-asking")
    homes = asking.join(leaders, "key").groupBy("class").agg(F.max(F.struct("size", "leader"))["leader"].alias("home"))
    rows_ = _dealt(large, leaders, sides, asking).join(sides, "class").join(homes, "class", "left")
    met = stored(rows_.groupBy("key", "x", "y").applyInArrow(_met, "home long, class long, asks boolean").distinct(), "jaccard-met")
    if not met.isEmpty():
        wanted = holders.join(met.select("class").distinct(), "class", "left_semi").select("row", "class", F.array().cast(_ASKED).alias("asked"))
        packed = texts.join(wanted, "row").dropDuplicates(["row"]).select("class", "asked", "text").mapInArrow(_packed, _PACKED).select("class", "shingles")
        dealt = _tasks(met.join(sides.select("class", "n"), "class").withColumn("answers", ~F.col("asks")), "home", EXACT_SETS, EXACT_SHINGLES)
        links = dealt.join(sides, "class").join(packed, "class").groupBy("home", "x", "y").applyInArrow(_all_links, "a long, b long")
        labels = _joined(labels, links)
    dropped(shared)

    named = stored(labels.join(holders.select("class", "least_id"), "class").groupBy("label").agg(F.min("least_id").alias("least_id")), "jaccard-named")
    classes = stored(labels.join(named, "label").select("class", F.col("label").alias("group"), "least_id"), "jaccard-groups")
    grouped = rows.select("row", "doc_id", "n_shingles", "class").join(classes, "class", "left")
    return grouped.select("row", "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"), "group")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (class, label) after links (a, b) between classes."""
    end = lambda c: labels.select(F.col("class").alias(c), F.col("label").alias(f"label_{c}"))
    between = stored(links.join(end("a"), "a").join(end("b"), "b").where("label_a != label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "jaccard-links")
    if between.isEmpty():
        return labels
    merged = components(between, "jaccard").select(F.col("v").alias("label"), F.col("label").alias("to"))
    return stored(labels.join(merged, "label", "left").select("class", F.coalesce("to", "label").alias("label")), "jaccard-labels")
