"""Alignment of two tokenizers: which tokens of one cover which of the other, and how often ids go together in the whole corpus.

Both tokenizers encode a whole text: a byte-level one (its texts get a space in front) and a SentencePiece model (which adds that
space itself). Ends that both share before a token that begins with a space are anchors: they split a text into windows of a few ids, and the
alignment of a window only depends on its ids, so it is worked out once for a task and remembered by the two id tuples. Inside a window shared
ends cut groups, and the two tokens that end a group are linked.

How often two ids are linked is counted over all texts. Each text then looks its own links up: ids linked in many texts (a bounded
number, see SPLIT) are broadcast, the others are shuffled, so no frequent pair is one join key for all texts.

Rows in: `text`; every row comes out once. Other columns, whatever their names, are carried in `row`; text itself is not. Null, empty and
texts whose tokens do not spell the space and the text (as with U+2581 in them) have no tokens. Very long texts without white space are one
window. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_texts, stored, struct_array
from .pieces import Model, Numbers, model_path

#: Windows that a task remembers, and the links in them: bounds its memory, as beyond it forgets them all before the next batch.
WINDOWS, LINKS = 200_000, 2_000_000
#: Pairs in more than one of SPLIT (text, pair) rows are broadcast; there cannot be more than SPLIT of them.
SPLIT = 100_000

_KIND = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,groups_sha256:string,pairs:array<bigint>,times:array<int>>"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others as letters from 256 on in their order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE vocabulary in the json of the tokenizers library, without its special tokens.

    Its ids must rise with its merges, as then they are ranks; text is split by the pattern. Else ValueError.
    """

    def __init__(self, data: str, pattern: str):
        spec = json.loads(data)
        vocabulary, letters = spec["model"]["vocab"], byte_letters()
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("only byte-level vocabularies whose ids rise with their merges are supported")
        special = {t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if i not in special}
        self.raw: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        self._library = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self._library.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class Aligner:
    """Aligns batches of texts; windows met before are looked up."""

    def __init__(self, a: ByteTokens, b: Model):
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([len(t) for t in raw]) for raw in (a.raw, b.shown))
        self.spaced = np.array([t.startswith(b" ") for t in a.raw])
        # an id before another of its side, before the other side, and at the end of a group
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(max(len(a.raw), len(b.raw)))]
        self._forget()

    def _forget(self) -> None:
        """Windows have numbers in the order in which they came: their groups as text, and their links in `flat` from first[number]."""
        self.known, self.groups = Numbers(), []
        self.first, self.flat = np.zeros(1, np.int64), np.empty(0, np.int64)

    def rows(self, texts: list[str]) -> pa.Array:
        """Of each text the numbers of tokens and groups, the digest of the groups, and its links with their numbers."""
        spelled, ids_a, ids_b = [], [], []
        for i, (text, b) in enumerate(zip(texts, self.b.pieces_of([self.b.normalise(t)[0] for t in texts]), strict=True)):
            whole, a = b" " + text.encode("utf-8", "replace"), self.a.encode(" " + text)
            if text and b"".join(map(self.a.raw.__getitem__, a.tolist())) == whole == b"".join(map(self.b.shown.__getitem__, b.tolist())):
                spelled.append(i)
                ids_a.append(a)
                ids_b.append(b)
        found = dict(zip(spelled, self._aligned(ids_a, ids_b), strict=True)) if spelled else {}
        size = {i: (len(a), len(b)) for i, a, b in zip(spelled, ids_a, ids_b, strict=True)}
        shas, pairs, times, n_groups = [], [], [], []
        for i in range(len(texts)):
            groups, links = found.get(i, ("", np.empty(0, np.int64)))
            pair, n = np.unique(links, return_counts=True)
            shas.append(hashlib.sha256(groups.encode()).hexdigest() if i in found else "")
            pairs.append(pair)
            times.append(n.astype(np.int32))
            n_groups.append(len(links))
        count = lambda k: pa.array([size.get(i, (0, 0))[k] for i in range(len(texts))], pa.int64())
        return struct_array({"n_a": count(0), "n_b": count(1), "n_groups": pa.array(n_groups, pa.int64()), "groups_sha256": pa.array(shas, pa.string()), "pairs": _lists(pairs, pa.int64()), "times": _lists(times, pa.int32())})

    def _aligned(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> list[tuple[str, np.ndarray]]:
        """Groups as text and links of texts that both sides spell, so bytes of all texts count on together."""
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        shared = np.zeros(ends_a[-1] + 1, np.int8)
        shared[ends_a] = 1
        shared[ends_b] += 1
        # anchors: shared ends before a token with a space, and ends of texts
        texts = np.cumsum([len(x) for x in ids_a])
        anchor = np.append(self.spaced[a[1:]], True) & (shared[ends_a] == 2)
        anchor[texts - 1] = True
        at = np.zeros(len(shared), bool)
        at[ends_a[anchor]] = True
        stop_a, stop_b = np.flatnonzero(anchor) + 1, np.flatnonzero(at[ends_b]) + 1
        which = self._numbered(a, b, stop_a, stop_b, shared[ends_a] == 2, shared[ends_b] == 2)
        sizes = self.first[which + 1] - self.first[which]
        links = _gathered(self.flat, self.first[which], sizes)
        out, low, of = [], 0, np.append(0, np.cumsum(sizes))
        for high in np.searchsorted(stop_a, texts, "right").tolist():
            out.append(("".join(map(self.groups.__getitem__, which[low:high].tolist()))[:-1], links[of[low] : of[high]]))
            low = high
        return out

    def _numbered(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
        """The number of each window by its ids of both sides; those not met before are aligned. ends: whether a token's end is shared."""
        if len(self.known) > WINDOWS or len(self.flat) > LINKS:
            self._forget()
        low_a, low_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
        key = _interleaved(a, b, low_a, stop_a, low_b, stop_b)
        stop = ((stop_a + stop_b + np.arange(1, len(stop_a) + 1)) * 4).tolist()
        held, data = len(self.known), key.tobytes()
        which = np.fromiter(map(self.known.__getitem__, map(data.__getitem__, map(slice, [0, *stop], stop))), np.int64, len(stop))
        new, at = np.unique(which, return_index=True)
        at = at[new >= held]
        if len(at):
            self._align(a, b, low_a[at], stop_a[at], low_b[at], stop_b[at], ends_a, ends_b)
        return which

    def _align(self, a: np.ndarray, b: np.ndarray, low_a: np.ndarray, stop_a: np.ndarray, low_b: np.ndarray, stop_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        """Groups and links of windows: shared ends cut the groups, and the two tokens that end there are linked."""
        in_a, in_b = (_gathered(np.arange(len(x)), low, stop - low) for x, low, stop in ((a, low_a, stop_a), (b, low_b, stop_b)))
        a, b, ends_a, ends_b = a[in_a], b[in_b], ends_a[in_a], ends_b[in_b]
        cut_a, cut_b = np.flatnonzero(ends_a) + 1, np.flatnonzero(ends_b) + 1
        # ids with the mark behind them, group by group
        step = len(self.shown) // 3
        marked = _interleaved(a + step * ends_a, b + 2 * step * ends_b, np.append(0, cut_a[:-1]), cut_a, np.append(0, cut_b[:-1]), cut_b, 0)
        text = list(map(self.shown.__getitem__, marked.tolist()))
        last = (np.cumsum(stop_a - low_a) + np.cumsum(stop_b - low_b)).tolist()
        self.groups += ["".join(text[i:k]) for i, k in zip([0, *last], last, strict=False)]
        self.flat = np.concatenate([self.flat, a[cut_a - 1] << 32 | b[cut_b - 1]])
        self.first = np.concatenate([self.first, self.first[-1] + np.searchsorted(cut_a, np.cumsum(stop_a - low_a), "right")])


def _gathered(values: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[low:low + size] of many ranges, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + sizes, sizes)]


def _interleaved(a: np.ndarray, b: np.ndarray, low_a: np.ndarray, stop_a: np.ndarray, low_b: np.ndarray, stop_b: np.ndarray, gap: int = 1) -> np.ndarray:
    """Ranges of a and of b in turn, as 32-bit numbers, with -1 between the two of each turn if `gap` is 1. Ranges follow each other."""
    turn = np.arange(len(stop_a))
    out = np.full(len(a) + len(b) + gap * len(turn), -1, np.int32)
    out[np.arange(len(a)) + np.repeat(low_b + gap * turn, stop_a - low_a)] = a
    out[np.arange(len(b)) + np.repeat(stop_a + gap * (turn + 1), stop_b - low_b)] = b
    return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0), kind))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, pattern: str | None = None) -> DataFrame:
    """row, numbers of tokens and groups, the digest of the groups, and the links as pairs (A's id above 32 bits, B's below) with their numbers. Vocabularies (of a fixed size) are broadcast."""
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or model_path()
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast((a.read(), pattern or public_tokenizers.PATTERN, b.read()))

    def run(texts: pa.Array) -> pa.Array:
        if (path_a, path_b) not in _aligners:
            json_a, split, model = shared.value
            _aligners[path_a, path_b] = Aligner(ByteTokens(json_a, split), Model(model))
        return _aligners[path_a, path_b].rows([t or "" for t in texts.to_pylist()])

    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]) if len(docs.columns) > 1 else F.struct(F.lit(None).alias("none"))
    return docs.select(carried.alias("row"), on_texts(_KIND, run)(F.col("text").cast("string")).alias("found")).select("row", "found.*")


def links(coded: DataFrame) -> DataFrame:
    """pair, count (links of all texts), n_texts, and whether no other id of A is linked more often with its B id."""
    counts = coded.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"), F.count("*").alias("n_texts"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "align-pairs")
    # as many rows as the vocabulary of B has ids
    best = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(best), "b").select("pair", "count", "n_texts", (F.col("count") == F.col("highest")).alias("is_best"))


def cross_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """row, n_a, n_b, n_groups, n_links, n_best (links that are the most frequent of their B id), count_sum (counts of all links added up), groups_sha256."""
    coded = stored(aligned(docs, path_a, path_b).withColumn("key", F.monotonically_increasing_id()), "align-texts")
    counts = stored(links(coded), "align-links")
    limit = F.broadcast(counts.agg((F.sum("n_texts") / SPLIT).alias("limit")))
    split = counts.crossJoin(limit).withColumn("often", F.col("n_texts") > F.col("limit")).select("pair", "count", "is_best", "often")
    own = coded.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    often = split.where("often").drop("often")
    found = own.join(F.broadcast(often), "pair").unionByName(own.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(split.where("not often").drop("often"), "pair").select("pair", "key", "times", "count", "is_best"))
    sums = found.groupBy("key").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    texts = coded.select("key", F.struct("row", "n_a", "n_b", "n_groups", F.aggregate("times", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_links"), "groups_sha256").alias("of"))
    none = F.lit(None).cast("long")
    each = texts.select("key", "of", none.alias("n_best"), none.alias("count_sum")).unionByName(sums.select("key", F.lit(None).cast(texts.schema["of"].dataType).alias("of"), "n_best", "count_sum"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    merged = each.groupBy("key").agg(F.first("of", True).alias("of"), zero("n_best"), zero("count_sum"))
    return merged.select("of.row", "of.n_a", "of.n_b", "of.n_groups", "of.n_links", "n_best", "count_sum", "of.groups_sha256")
