"""Benchmark decontamination: an FM-index per training shard, searched backwards for every test phrase.

A shard is a run of documents of one task. Its words are numbered by the test phrases' vocabulary; words outside it, and runs too
short for the shortest phrase, cannot be part of a hit and only separate. Over the rest the task sorts suffixes, keeps the
Burrows-Wheeler transform as a wavelet matrix and every SAMPLE-th suffix position, narrows all phrases' intervals together from
their last word to their first by ranks, locates the occurrences by walking back to a sampled position, and merges the spans.

Rows in: documents with `text`, and a benchmark with `item_id`, `text`. Null and empty texts have no words. Benchmark rows without
words ask for nothing; repeated item_ids count once; an item without id marks words but is not listed. Every document row comes
out once in `row`, repeated rows too; other columns, whatever their names, stay inside it. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import ALNUM_TABLE, NONWORD, Words, as_bytes, on_texts, stored, struct_array

PHRASE = 10
SAMPLE = 8
#: Bytes of benchmark text that one broadcast holds; a larger benchmark is split by hash and searched block after block, one of them in memory at a time.
BLOCK_BYTES = 4_000_000


class Phrases:
    """Test phrases as rows of word numbers (1 on), and the items of each."""

    def __init__(self, items: Iterable[tuple[int | None, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in (text or "").encode().translate(ALNUM_TABLE).split()]
            n = min(PHRASE, len(words))
            for i in range(len(words) - n + 1) if n else ():
                found.setdefault(tuple(words[i : i + n]), set()).add(item)
        self.sizes = np.array([len(p) for p in found], np.int64)
        self.table = np.zeros((len(found), PHRASE), np.int64)
        for i, p in enumerate(found):
            self.table[i, : len(p)] = p
        self.items = [sorted(x for x in s if x is not None) for s in found.values()]
        self.shortest = int(self.sizes.min()) if len(found) else 0


class Wavelet:
    """Wavelet matrix over numbers below `sigma`: rank of a symbol before a position, for many queries at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(before), before
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; the end of the text is smallest."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        key = rank * (n + 2)
        key[: n - width] += rank[width:]
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(key[order[1:]] != key[order[:-1]])])
        if new[order[-1]] == n:
            return order
        rank, width = new, min(width * 2, n - 1)


class Index:
    """FM-index of one shard. Symbol 0 separates runs and is never searched, so the place after each 0 is sampled too."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n = len(text)
        order = suffix_array(text)
        before = text[order - 1]
        before[order == 0] = 0
        self.before = before
        self.wavelet = Wavelet(before, sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        for step in range(PHRASE):
            live = np.flatnonzero((sizes > step) & (high > low))
            if not len(live):
                break
            symbol = phrases[live, sizes[live] - 1 - step]
            low[live], high[live] = (self.smaller[symbol] + self.wavelet.rank(symbol, x[live]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        while len(open_ := np.flatnonzero(~self.sampled[rows])):
            symbol = self.before[rows[open_]]
            rows[open_] = self.smaller[symbol] + self.wavelet.rank(symbol, rows[open_])
            walked[open_] += 1
        return self.positions[self.place[rows]] + walked


def _runs(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of nonzero numbers that are long enough."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def search_shard(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(start, phrase) of every occurrence in a shard, whose word numbers are 0 outside the vocabulary and between documents."""
    starts, ends = _runs(ids, phrases.shortest)
    if not len(starts) or not phrases.shortest:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = ends - starts + 1
    offset = np.concatenate([[0], np.cumsum(lengths)])
    source = np.arange(offset[-1]) + np.repeat(starts - offset[:-1], lengths)
    text = np.append(ids, 0)[source]
    text[offset[1:] - 1] = 0
    index = Index(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.table, phrases.sizes)
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
    return source[index.locate(rows)], which


def _numbered(texts: pa.Array, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a shard, a 0 after each document, and the documents' bounds."""
    number, parts, bounds = vocabulary.get, [np.empty(0, np.int64)], [0]
    for text in as_bytes(texts):
        words = text.translate(ALNUM_TABLE).split()
        parts += [np.fromiter((number(w, 0) for w in words), np.int64, len(words)), np.zeros(1, np.int64)]
        bounds.append(bounds[-1] + len(words) + 1)
    return np.concatenate(parts), np.array(bounds)


def _searcher(shared: Broadcast, cut: bool = False) -> Callable[[Column], Column]:
    """A function of a text column: its number of words, the items found and their merged spans; with `cut` also what is left of a text that has spans."""

    def run(texts: pa.Array) -> pa.Array:
        phrases: Phrases = shared.value
        ids, bounds = _numbered(texts, phrases.vocabulary)
        at, which = search_shard(ids, phrases)
        order = np.argsort(at, kind="stable")
        at, which = at[order], which[order]
        low = np.searchsorted(at, bounds)
        items, spans = [], []
        for i in range(len(texts)):
            mine, kinds = at[low[i] : low[i + 1]] - bounds[i], which[low[i] : low[i + 1]]
            items.append(sorted({x for k in set(kinds.tolist()) for x in phrases.items[k]}))
            spans.append(merged(mine, mine + phrases.sizes[kinds]))
        found = {"n_words": pa.array(np.diff(bounds) - 1), "items": pa.array(items, pa.list_(pa.int64())), "spans": pa.array(spans, pa.list_(_SPAN))}
        if cut:
            found["left"] = pa.array([_left(texts[i].as_py(), s) if s else None for i, s in enumerate(spans)], pa.string())
        return struct_array(found)

    return on_texts("struct<n_words:bigint,items:array<bigint>,spans:array<struct<start:bigint,end:bigint>>" + ",left:string" * cut + ">", run)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Union of spans, sorted by start."""
    out: list[dict] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """`row`, n_words, items (ids found, each once) and spans [start, end) of hit words, merged, of every document.

    With `cut` a benchmark of one block also gives `left`, the texts that have spans without them, in the same pass.

    All blocks of the benchmark but the last are searched one by one, each with a broadcast of its own that is destroyed
    afterwards; what they find is stored by text, and the last block's pass takes it along.
    """
    spark = docs.sparkSession
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    block = lambda b: spark.sparkContext.broadcast(Phrases((r.item_id, r.text) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toLocalIterator()))
    packed = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    if n == 1:
        return packed.select("row", _searcher(block(0), cut)(F.col("text")).alias("found")).select("row", "found.*")
    name = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"))  # 128 bits name a text
    texts, hits = packed.where("text is not null").select(name.alias("name"), "text"), None
    for b in range(n - 1):
        shared = block(b)
        part = stored(texts.select("name", _searcher(shared)(F.col("text")).alias("found")).where("size(found.spans) > 0").select("name", "found.items", "found.spans").distinct(), "decontaminate-block")
        hits = part if hits is None else hits.union(part)
        shared.destroy()
    before = stored(hits.groupBy("name").agg(F.flatten(F.collect_list("items")).alias("more_items"), F.flatten(F.collect_list("spans")).alias("more_spans")), "decontaminate-before")
    last = packed.withColumn("name", name).join(before, "name", "left").withColumn("found", _searcher(block(n - 1))(F.col("text")))
    both = lambda c: F.concat(F.col(f"found.{c}"), F.coalesce(F.col(f"more_{c}"), F.array().cast(dict(before.dtypes)[f"more_{c}"])))
    # spans of several blocks are merged once more
    join = lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    spans = F.aggregate(F.array_sort(both("spans")), F.array().cast("array<struct<start:bigint,end:bigint>>"), join)
    return last.select("row", "found.n_words", F.array_distinct(both("items")).alias("items"), spans.alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of what decontaminate() found."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span, spans being sorted and apart."""
    data = text.encode()
    words = Words([data], NONWORD, True)
    at, out = 0, []
    for a, b in spans:
        out.append(data[at : words.starts[a]])
        at = int(words.ends[b - 1])
    return b"".join([*out, data[at:]]).decode()


def _left(text: str, spans: list[dict]) -> str:
    return remove_words(text, [(s["start"], s["end"]) for s in spans])


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _left(t, x) for t, x in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def removed(found: DataFrame) -> DataFrame:
    """`row` with `text` being what is left of the document after its spans are removed. Only texts with spans go to Python for that, if decontaminate() has not done it."""
    text = F.col("row.text").cast("string")
    left = F.col("left") if "left" in found.columns else F.arrow_udf(_cut, StringType())(F.when(F.size("spans") > 0, text), F.col("spans"))
    return found.select("row", F.coalesce(left, text).alias("text"))
