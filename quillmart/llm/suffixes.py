"""Suffix-array dedup with sparse suffix arrays: passages of fifty words or more that occur twice.

Only suffixes at minimisers are kept: the least eight-word hash among those inside each fifty-word window, so both places of any
passage that long keep the same suffixes. Spark's shuffle brings the suffixes that begin with the same eight words together, each
with the words around it that its windows reach; those alone in their place are dropped. There they are sorted, neighbours are
compared, and matches are extended to the right by the lengths that neighbours share; the words before them, sorted backwards,
extend the matches to the left in the same way. A window of a words before and 50 - a words from a suffix on is repeated exactly if
another suffix shares that much on both sides. Overlapping windows merge into spans. So a word is in a span exactly if it lies in a
fifty-word window that occurs at two places.

Windows that one text holds twice are found within it, by hash, and only the first of them has a suffix, so a text of repeated words is no
larger group than another. A suffix that very many places share is dealt over several tasks, by text and place; what each finds once
there is compared once more by hash.

Rows in: `doc_id`, `text`; words are `[^\\x20\\x09-\\x0D]+`. Null, empty and short texts have no passages and no result row. Rows
equal in doc_id and text count as one document. The first place of a passage is that with the least doc_id (null last), then the
least start. Texts may be as long as Spark can hold (2^31 bytes). Other columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Words, as_bytes, gram_hashes, packed_schema, range_hashes, row_key, row_seed, steps, stored, word_hashes

PASSAGE = 50
PREFIX = 8
#: Places of one suffix prefix that one task takes.
MOST_PLACES = 10_000
#: Prefixes with more than one of FREQUENT places are broadcast to their suffixes; there are fewer than FREQUENT.
FREQUENT = 50_000
#: Rows that a task compares at once, cut between prefixes.
TOGETHER = 10_000
#: A text of 2^31 bytes has at most 2^30 words.
_POSITION_BITS = 30


def minimisers(grams: np.ndarray) -> np.ndarray:
    """For each fifty-word window of a text the place of its least eight-word hash (its upper bits; the first of equals); block-wise running minima."""
    width = PASSAGE - PREFIX + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    coded = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(coded) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(coded)] = coded
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive windows as starts and ends of their words."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + PASSAGE


def _own_copies(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of one text those that an earlier one equals, as flags, and those that only later ones equal, as places."""
    n = len(words) - PASSAGE + 1
    names = range_hashes(words, np.arange(n), np.arange(n) + PASSAGE)
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    held = order[:-1][same]
    return again, np.sort(held[~again[held]])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept suffixes of each text (prefix, row, at), and the runs of words that it repeats within itself (row, doc_id, start, end, later).

    Windows that an earlier one of their text equals need no suffix, so a text of one word over and over has one.
    """
    for batch in steps(batches, "text"):
        words = Words(as_bytes(batch.column("text")), SPACE, False)
        grams = gram_hashes(words.hashes, PREFIX)
        columns: list[list[np.ndarray]] = [[] for _ in _ANCHOR_TYPES]
        rows, docs = batch.column("row").to_pylist(), batch.column("doc_id")
        for i, (low, high) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            if high - low < PASSAGE:
                continue
            again, copied = _own_copies(words.hashes[low:high])
            at = minimisers(grams[low : high - PREFIX + 1])[~again]
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            parts = [(grams[low + at].view(np.int64), at, None, None, None)]
            for starts, later in ((np.flatnonzero(again), True), (copied, False)):
                if len(starts):
                    parts.append((None, None, *_runs(starts), later))
            for prefix, place, start, end, later in parts:
                n = len(place if start is None else start)
                none = lambda kind, n=n: pa.nulls(n, kind)
                values = (none(pa.int64()) if prefix is None else prefix, np.full(n, rows[i], np.int64), none(pa.int64()) if place is None else place, docs.take(pa.array(np.full(n, i))), none(pa.int64()) if start is None else start, none(pa.int64()) if end is None else end, none(pa.bool_()) if later is None else np.full(n, later))
                for column, value, kind in zip(columns, values, _ANCHOR_TYPES, strict=True):
                    column.append(value if isinstance(value, pa.Array) else pa.array(value, kind))
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], _ANCHOR_NAMES)


_ANCHOR = "prefix long, row long, at long, doc_id long, start long, end long, later boolean"
_ANCHOR_NAMES = [f.split()[0] for f in _ANCHOR.split(", ")]
_ANCHOR_TYPES = [*[pa.int64()] * 6, pa.bool_()]


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each kept suffix of a text the start of its first window, the words before it, its number of windows, and the bytes of all words that they reach."""
    for batch in steps(batches, "text"):
        texts = as_bytes(batch.column("text"))
        words = Words(texts, SPACE, False)
        grams = gram_hashes(words.hashes, PREFIX)
        columns: list[list] = [[] for _ in _EXTENDED_NAMES]
        for i, (low, high) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            at = minimisers(grams[low : high - PREFIX + 1])
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ends = np.append(starts[1:], len(at))
            from_, to = words.starts[low + starts] - words.base[i], words.ends[low + ends + PASSAGE - 2] - words.base[i]
            hits = {h["at"]: h for h in batch.column("hits")[i].as_py()}
            for place, a, b, c, d in zip(at[starts].tolist(), starts.tolist(), ends.tolist(), from_.tolist(), to.tolist(), strict=True):
                if hit := hits.get(place):
                    values = (hit["prefix"], hit["salts"], batch.column("row")[i].as_py(), batch.column("doc_id")[i].as_py(), a, place - a, b - a, texts[i][c:d])
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EXTENDED_TYPES, strict=True)], _EXTENDED_NAMES)


_EXTENDED = "prefix long, salts int, row long, doc_id long, start long, before int, windows int, words binary"
_EXTENDED_NAMES = [f.split()[0] for f in _EXTENDED.split(", ")]
_EXTENDED_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_FOUND = "row long, doc_id long, start long, end long, later boolean, hash long, places long"
_FOUND_NAMES = [f.split()[0] for f in _FOUND.split(", ")]
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]


def _shared_lengths(groups: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts lines of words within their groups: the order, and how many words each shares with the one before (-1 across groups)."""
    order = np.lexsort((*lines.T[::-1], groups))
    same = lines[order[1:]] == lines[order[:-1]]
    shared = np.where(same.all(axis=1), lines.shape[1], same.argmin(axis=1))
    return order, np.concatenate([[-1], np.where(groups[order[1:]] == groups[order[:-1]], shared, -1)])


def window_classes(groups: np.ndarray, words: np.ndarray, first: np.ndarray, before: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, window's place among its windows, class) of all windows of the suffixes; equal windows of one group, and only those, have one class.

    words: hashes of the words around all suffixes, those of suffix i beginning at first[i], its own first word being before[i] words on.
    """
    n, at = len(first), first + before
    reach = first + windows + PASSAGE - 1  # the end of each suffix's words
    right = at[:, None] + np.arange(PASSAGE)
    left = at[:, None] - 1 - np.arange(PASSAGE - PREFIX)
    padded = np.append(words, np.uint64(0))
    # beyond a suffix's own words no window of it reaches; the filler may match only filler
    after = np.where(right < reach[:, None], padded[np.minimum(right, len(words))], np.uint64(0))
    ahead = np.where(left >= first[:, None], padded[np.maximum(left, 0)], np.uint64(0))
    order_right, share_right = _shared_lengths(groups, after)
    order_left, share_left = _shared_lengths(groups, ahead)
    owners, places, classes = [], [], []
    made = 0
    run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(PASSAGE - PREFIX + 1):
        offset = before - a
        own = np.flatnonzero((offset >= 0) & (offset < windows))
        if not len(own):
            continue
        run_right[order_right] = np.cumsum(share_right < PASSAGE - a)
        run_left[order_left] = np.cumsum(share_left < a)
        _, found = np.unique(run_right[own] * (n + 1) + run_left[own], return_inverse=True)
        owners.append(own)
        places.append(offset[own])
        classes.append(found + made)
        made += int(found.max()) + 1
    return np.concatenate(owners), np.concatenate(places), np.concatenate(classes)


def _matched(table: pa.Table) -> pa.RecordBatch:
    """Repeated windows of these suffixes as runs; of dealt-out suffixes also each window's first place here, still open (later is null)."""
    hashes, begins = word_hashes(table.column("words").to_pylist(), SPACE, False)
    prefixes, before, windows = (table.column(c).to_numpy().astype(np.int64) for c in ("prefix", "before", "windows"))
    owner, place, kinds = window_classes(prefixes, hashes, begins[:-1], before, windows)
    rows, starts = table.column("row").to_numpy()[owner], table.column("start").to_numpy()[owner] + place
    last = np.asarray(table.column("doc_id").is_null())[owner]
    docs = table.column("doc_id").fill_null(0).to_numpy()[owner]
    order = np.lexsort((starts, rows, docs, last, kinds))
    kinds, rows, starts, owner, place = (x[order] for x in (kinds, rows, starts, owner, place))
    same = np.concatenate([[False], kinds[1:] == kinds[:-1]])
    copy = same & np.concatenate([[False], (rows[1:] == rows[:-1]) & (starts[1:] == starts[:-1])])
    rows, starts, owner, place, same = (x[~copy] for x in (rows, starts, owner, place, same))
    first = np.flatnonzero(~same)
    places = np.diff(np.append(first, len(same)))
    dealt = table.column("salts").to_numpy()[owner] > 1
    later = np.flatnonzero(same)
    firsts = first[(places > 1) & ~dealt[first]]
    ids = table.column("doc_id").to_pylist()
    out: list[tuple] = []
    for chosen, is_later in ((later, True), (firsts, False)):
        if len(chosen):
            chosen = chosen[np.lexsort((starts[chosen], rows[chosen]))]
            cut = np.concatenate([[True], (rows[chosen[1:]] != rows[chosen[:-1]]) | (starts[chosen[1:]] != starts[chosen[:-1]] + 1)])
            heads = np.flatnonzero(cut)
            tails = np.append(heads[1:], len(chosen)) - 1
            out += [(int(rows[chosen[h]]), ids[owner[chosen[h]]], int(starts[chosen[h]]), int(starts[chosen[t]]) + PASSAGE, is_later, None, None) for h, t in zip(heads, tails, strict=True)]
    open_ = np.flatnonzero(~same & dealt)
    if len(open_):
        sizes, names = dict(zip(first.tolist(), places.tolist(), strict=True)), gram_hashes(hashes, PASSAGE).view(np.int64)
        out += [(int(rows[i]), ids[owner[i]], int(starts[i]), int(starts[i]) + PASSAGE, None, int(names[begins[owner[i]] + place[i]]), sizes[i]) for i in open_.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, _FOUND_TYPES, strict=True)], _FOUND_NAMES)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by prefix and salt; chunks are cut between those."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("prefix").to_numpy() ^ table.column("salt").to_numpy()
            cut = np.flatnonzero(keys[1:] != keys[:-1])
            if len(cut):
                yield _matched(table.slice(0, int(cut[-1]) + 1))
                held = table.slice(int(cut[-1]) + 1).to_batches()
    if held:
        yield _matched(pa.Table.from_batches(held).combine_chunks())


def repeats(docs: DataFrame, most_places: int = MOST_PLACES, seed: int | None = None) -> DataFrame:
    """Runs of repeated words: row (row_key of doc_id and text), doc_id, start, end, later (not the first place). Runs may overlap."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(row_seed(docs) if seed is None else seed).alias("row"))
    anchors = stored(texts.mapInArrow(_anchors, _ANCHOR), "suffix-anchors")
    own = anchors.where("prefix is null").select("row", "doc_id", "start", "end", "later")
    anchors = anchors.where("prefix is not null").select("prefix", "row", "at")
    shared = stored(anchors.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix", F.ceil(F.col("n") / most_places).cast("int").alias("salts"), "n"), "suffix-prefixes")
    limit = F.broadcast(shared.agg((F.sum("n") / FREQUENT).alias("limit")))
    often = F.broadcast(shared.crossJoin(limit).where("n > limit").select("prefix", "salts"))
    seldom = shared.crossJoin(limit).where("n <= limit").select("prefix", "salts")
    kept = anchors.join(often, "prefix").unionByName(anchors.join(often.select("prefix"), "prefix", "left_anti").join(seldom, "prefix"))
    hits = kept.groupBy("row").agg(F.collect_set(F.struct("at", "prefix", "salts")).alias("hits"))
    suffixes = texts.join(hits, "row").mapInArrow(_extended, _EXTENDED)
    dealt = suffixes.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.col("salts").cast("long")))
    found = dealt.repartition("prefix", "salt").sortWithinPartitions("prefix", "salt").mapInArrow(_compared, _FOUND)
    found = stored(found, "suffix-found")

    opened = found.where("later is null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")
    firsts = opened.groupBy("hash").agg(F.sum("places").alias("total"), F.min(place).alias("first")).where("total > 1")
    closed = opened.drop("later").join(firsts, "hash").withColumn("later", place != F.col("first"))
    columns = ["row", "doc_id", "start", "end", "later"]
    return found.where("later is not null").select(columns).union(closed.select(columns)).union(own.select(columns))


def _spans(runs: DataFrame) -> DataFrame:
    """Union of the runs of each document, as a sorted array of [start, end)."""
    along = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(along)
    joined = runs.withColumn("reach", reach).withColumn("island", island).groupBy("row", "island").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_passages(docs: DataFrame, seed: int | None = None) -> DataFrame:
    """For each document with repeated passages: row, doc_id, spans of all their words and later_spans of those whose first place is elsewhere."""
    runs = stored(repeats(docs, seed=seed), "suffix-runs")
    all_ = _spans(runs.select("row", "doc_id", "start", "end"))
    later = _spans(runs.where("later").select("row", "doc_id", "start", "end")).select("row", F.col("spans").alias("later_spans"))
    return all_.join(later, "row", "left").select("row", "doc_id", "spans", F.coalesce("later_spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("later_spans"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of repeated words and of those that are later copies, and both lists of spans as text."""
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", size("spans").alias("n_repeated"), size("later_spans").alias("n_later"), text("spans").alias("spans"), text("later_spans").alias("later_spans"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        out = []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("later_spans").to_pylist(), strict=True):
            words, at, kept = Words([text], SPACE, False) if spans else None, 0, []
            for s in spans or ():
                kept.append(text[at : words.starts[s["start"]]])
                at = int(words.ends[s["end"] - 1])
            out.append(b"".join([*kept, text[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.string())], ["doc", "text"])


def without_copies(docs: DataFrame) -> DataFrame:
    """`doc` (all columns of docs) and `text`: what is left when later copies of repeated passages are cut out."""
    seed = row_seed(docs)
    found = repeated_passages(docs, seed).select(F.col("row").alias("found_row"), "later_spans")
    packed = docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"), row_key(seed).alias("row"))
    joined = packed.join(found, F.col("row") == F.col("found_row"), "left").select("doc", "text", "later_spans")
    return joined.mapInArrow(_without, packed_schema(joined.schema["doc"], "text string"))
