"""Byte-level BPE by monoid tree reduction.

A text is halved until its parts are leaves; each leaf is encoded on its own. Two neighbours join by re-encoding a window around
their border that grows on either side until it reaches a place where white space follows a character that is none. There every
match of the pattern ends, whatever stands around it (each class of characters but white space excludes white space, and the one
look-ahead only concerns runs of white space), so no token outside the window can change. Decoding concatenates bytes up the
same tree.

Rows in: `text`. Every row comes out once in `row`, with its ids and the decoded bytes; null is the empty text. Other columns,
whatever their names, stay inside `row`. Very long texts and texts without any white space take larger windows, at worst the whole text.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_texts, struct_array

#: Characters of a leaf, so that all but the shortest texts are put together by the tree.
LEAF = 128
WINDOW = 32
#: White space as the pattern's \\s has it.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Leaf encoder, joins and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token = {i: b for b, i in ranks.items()}.__getitem__

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Ids of the whole text; the tree's joins run in order of their borders' depth."""

        def tree(low: int, high: int) -> list[int]:
            if high - low <= leaf:
                return self.leaf(text[low:high])
            middle = (low + high) // 2
            return self.join(text, low, middle, high, tree(low, middle), tree(middle, high))

        return tree(0, len(text))

    def join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[low:high] from those of its two parts."""
        if not left or not right or self._stable(text, middle):
            return left + right
        start, end = self._border(text, middle, low, -1), self._border(text, middle, high, 1)
        drop = len(text[start:middle].encode())
        while drop:
            drop -= len(self.token(left.pop()))
        skip, at = len(text[middle:end].encode()), 0
        while skip:
            skip -= len(self.token(right[at]))
            at += 1
        return left + self.leaf(text[start:end]) + right[at:]

    @staticmethod
    def _stable(text: str, at: int) -> bool:
        return text[at] in WHITE and text[at - 1] not in WHITE

    def _border(self, text: str, middle: int, bound: int, way: int) -> int:
        """The stable place nearest to the border on one side, looked for in growing windows; the part's end if it has none."""
        reach, seen = WINDOW, 0
        while True:
            for step in range(seen + 1, reach + 1):
                at = middle + way * step
                if at * way >= bound * way:
                    return bound
                if self._stable(text, at):
                    return at
            reach, seen = reach * 2, reach

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up the tree of their halves."""
        if len(ids) <= LEAF:
            return b"".join(map(self.token, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_codecs: dict[str, Codec] = {}


def _with_codec(spark: SparkSession, path: str, pattern: str, step: Callable[[Codec, list[str]], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A function of a text column that runs step(codec, texts); the vocabulary (of a fixed size) is broadcast, so only the driver reads its file."""
    shared = spark.sparkContext.broadcast((read_ranks(path), pattern))

    def run(texts: pa.Array) -> pa.Array:
        if path not in _codecs:
            _codecs[path] = Codec(*shared.value)
        return step(_codecs[path], [t or "" for t in texts.to_pylist()])

    return on_texts(kind, run)


def vocabulary() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`row` (all columns of docs) and its ids."""

    def step(codec: Codec, texts: list[str]) -> pa.Array:
        return pa.array([codec.encode(t) for t in texts], pa.list_(pa.int32()))

    ids = _with_codec(docs.sparkSession, path or vocabulary()[0], pattern or vocabulary()[1], step, "array<int>")
    return docs.select(F.struct("*").alias("row"), ids(F.col("text").cast("string")).alias("ids"))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`row`, n_tokens and the SHA-256 of the ids and of the bytes decoded from them, in one pass over the texts."""

    def step(codec: Codec, texts: list[str]) -> pa.Array:
        n, of_ids, of_bytes = [], [], []
        for text in texts:
            ids = codec.encode(text)
            n.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return struct_array({"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())})

    found = _with_codec(docs.sparkSession, path or vocabulary()[0], pattern or vocabulary()[1], step, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    return docs.select(F.struct("*").alias("row"), found(F.col("text").cast("string")).alias("found")).select("row", "found.*")
