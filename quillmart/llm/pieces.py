"""SentencePiece BPE with offsets: normalisation by longest prefixes, merges by score, pieces projected to the bytes they came from.

A text is normalised by the compiled character map of the model (a double array of rules; at each place the longest rule that
fits), white space becomes U+2581, and every byte of the result keeps the byte of the text that it stems from. Merges run on words (a word
begins at U+2581 after another character; where a piece of the model goes over such a border the whole text is one word) by the
sentencepiece library, which gets the model without its normaliser; words met before are remembered. A piece's span in the normalised text leads through the kept places to its span in the text.

Rows in: `text`. Every row comes out once, in `row`, whatever the names of its columns; null is the empty text, which has the begin
and end ids alone. Very long texts without white space are one word. Bytes that are no UTF-8 count as U+FFFD.
An empty table gives an empty result. Models must be of the BPE kind; others raise ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_texts, struct_array

#: The mark of white space, the character for what is no UTF-8, and kinds of pieces.
SPACE, REPLACED = "▁", "�"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Words that a task remembers, and the pieces in them: bounds its memory, as beyond it forgets them all before the next batch.
WORDS, PIECES = 250_000, 2_500_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


def _without_normaliser(data: bytes) -> bytes:
    """The model with a normaliser (field 3) that leaves texts as they are: name identity, fields 3 to 5 (space in front, fewer spaces, escaped spaces) off."""
    plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
    message = lambda field, value: bytes([field << 3 | 2]) + _varint(len(value)) + value
    return b"".join(message(f, v) for f, v in _fields(data) if f != 3) + message(3, plain)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class CharacterMap:
    """The compiled rules: a double array over UTF-8 bytes and the replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.texts = compiled[4 + size :]
        #: Bytes that begin a rule: all other places need no look.
        self.begins = np.array([bool(self.units) and self._step(self._base(0), b) is not None for b in range(256)])

    def _base(self, at: int) -> int:
        unit = self.units[at]
        return at ^ (unit >> 10 << ((unit & 512) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest rule that fits at a place."""
        base, found = self._base(0), None
        for i in range(at, len(data)):
            node = self._step(base, data[i]) if data[i] else None
            if node is None:
                break
            base = self._base(node)
            if self.units[node] >> 8 & 1:
                value = self.units[base] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return found


class Model:
    """Pieces, normaliser, merges and decoder of one model file."""

    def __init__(self, data: bytes):
        pieces, kind, byte_fallback, norm = [], 1, False, {3: 1, 4: 1, 5: 1}
        suffix = False
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                pieces.append((part[1].decode(), part.get(3, NORMAL)))
            elif field == 2:
                trained = dict(_fields(value))
                kind, byte_fallback, suffix = trained.get(3, 1), bool(trained.get(35, 0)), bool(trained.get(24, 0))
            elif field == 3:
                norm |= dict(_fields(value))
        kinds = [k for _, k in pieces]
        if kind != BPE or USER in kinds or UNUSED in kinds or suffix or not norm[5]:
            raise ValueError("only BPE models whose spaces are escaped in front, without pieces defined by users, are supported")
        self.map = CharacterMap(norm.get(2, b""))
        self.prefix, self.tidy, self.byte_fallback = bool(norm[3]), bool(norm[4]), byte_fallback
        self.pieces = [p for p, _ in pieces]
        # texts are normalised here, so the library that merges words gets the model without its normaliser
        self.merge = partial(sentencepiece.SentencePieceProcessor(model_proto=_without_normaliser(data)).encode, num_threads=1)
        self.unknown = kinds.index(UNKNOWN)
        self.begin, self.end = (self.pieces.index(p) for p in ("<s>", "</s>"))
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        # what a piece is worth in bytes of the normalised text, and as decoded text
        self.raw = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.pieces)]
        self.sizes, self.is_byte = np.array([len(r) for r in self.raw]), np.isin(np.arange(len(pieces)), list(self.byte_of))
        self.shown = [b"" if i in self.control else r if i in self.byte_of else " ⁇ ".encode() if i == self.unknown else r.replace(SPACE.encode(), b" ") for i, r in enumerate(self.raw)]
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S) if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(self.pieces, kinds, strict=True) if k == NORMAL) else re.compile("(?s).+")
        # words have numbers in the order in which they came, and their ids lie in `flat` from first[number]
        self.known, self.first, self.flat = Numbers(), np.zeros(1, np.int64), np.empty(0, np.int64)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the text that it stems from (the first one of a character)."""
        data = text.encode("utf-8", "replace")
        if not data:
            return "", np.zeros(1, np.int64)
        array = np.frombuffer(data, np.uint8)
        values, source = array, np.arange(len(array))
        if len(data) > len(text):
            lead = (array & 0xC0) != 0x80
            source = np.maximum.accumulate(np.where(lead, source, 0))
            rules = self._rules(data, array, lead)
        else:
            rules = self._rules(data, array, True)
        if rules:
            values, source = self._replaced(array, source, rules)
        first, last = 0, len(array)
        space = values == 32
        if self.tidy:
            # none in front, and of several one, but for those inside a replacement; a replacement's first ones go together
            before, fixed, at = np.arange(-1, len(values) - 1), np.zeros(len(values), bool), 0
            for start, size, text in rules:
                low, lead = start + at, len(text) - len(text.lstrip(b" "))
                before[low : low + lead] = low - 1
                fixed[low + lead : low + len(text)] = True
                at += len(text) - size
            keep = np.flatnonzero(~space | fixed | ~np.append(space, True)[before])
            if not len(keep):
                return "", np.zeros(1, np.int64)
            # the space in front stands where the text's own leading spaces end
            at = {start: (size, text) for start, size, text in rules}
            while first < len(array) and at.get(first, (1, bytes([array[first]])))[1] == b" ":
                first += at.get(first, (1, b""))[0]
            values, source, space = values[keep], source[keep], space[keep]
        place = np.repeat(source, np.where(space, 3, 1))
        normal = values.tobytes().decode("utf-8", "replace").replace(" ", SPACE)
        if self.prefix:
            normal, place = SPACE + normal, np.concatenate([[first, first, first], place])
        if self.tidy and (n := len(normal) - len(normal.rstrip(SPACE))):
            last = place[-3 * n]
            normal, place = normal[:-n], place[: -3 * n]
        return normal, np.append(place, last)

    def _rules(self, data: bytes, array: np.ndarray, lead: np.ndarray | bool) -> list[tuple[int, int, bytes]]:
        """Place, length and replacement of the rules that apply, from left to right."""
        out, done = [], 0
        if self.map.units:
            for at in np.flatnonzero(self.map.begins[array] & lead).tolist():
                if at >= done and (rule := self.map.longest(data, at)):
                    out.append((at, *rule))
                    done = at + rule[0]
        return out

    @staticmethod
    def _replaced(array: np.ndarray, source: np.ndarray, rules: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and their places after the rules; runs that no rule touches stay."""
        values, places, done = [], [], 0
        for at, size, text in rules:
            values += [array[done:at], np.frombuffer(text, np.uint8)]
            places += [source[done:at], np.full(len(text), at)]
            done = at + size
        return np.concatenate([*values, array[done:]]), np.concatenate([*places, source[done:]])

    def pieces_of(self, normal: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts, without begin and end; words met before are not merged again."""
        if not normal:
            return []
        words = list(map(self.split.findall, normal))
        if len(self.known) > WORDS or len(self.flat) > PIECES:
            self.known, self.first, self.flat = Numbers(), np.zeros(1, np.int64), np.empty(0, np.int64)
        held = len(self.known)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64)
        if len(self.known) > held:
            merged = self.merge(list(islice(self.known, held, None)))
            sizes = np.fromiter(map(len, merged), np.int64, len(merged))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(merged), np.int64, int(sizes.sum()))])
        low, sizes = self.first[which], self.first[which + 1] - self.first[which]
        end = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.arange(end[-1]) + np.repeat(low - end[:-1], sizes)]
        return np.split(ids, end[np.cumsum([len(w) for w in words])][:-1])

    def spans(self, normal: str, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the text that each piece stems from: begins and ends. Of the bytes of a character without a piece the last has its span and the others an empty one before it."""
        ends = np.cumsum(self.sizes[ids] if self.byte_fallback else self._sizes_with_unknown(normal, ids))
        low, high = place[np.append(0, ends[:-1])], place[ends]
        if self.is_byte[ids].any():
            # a byte in the middle of a character ends where it begins
            inside = np.frombuffer(normal.encode() + b"a", np.uint8)[ends] & 0xC0 == 0x80
            high = np.where(inside, low, high)
        return low, high

    def _sizes_with_unknown(self, normal: str, ids: np.ndarray) -> np.ndarray:
        at, sizes = 0, []
        for i in ids.tolist():
            n = 1 if i == self.unknown else len(self.pieces[i])
            sizes.append(len(normal[at : at + n].encode()))
            at += n
        return np.array(sizes, np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the ids with begin and end, and the bytes of the text that each stems from."""
        normal = [self.normalise(t) for t in texts]
        out = []
        for text, (plain, place), ids in zip(texts, normal, self.pieces_of([n for n, _ in normal]), strict=True):
            size = len(text) if text.isascii() else len(text.encode("utf-8", "replace"))
            low, high = self.spans(plain, place, ids) if plain else ([], [])
            out.append((np.concatenate([[self.begin], ids, [self.end]]), np.concatenate([[0], low, [size]]).astype(np.int64), np.concatenate([[0], high, [size]]).astype(np.int64)))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: spaces come back, the space that normalising puts in front goes, and bytes that are no UTF-8 become U+FFFD."""
        at, shown = 0, list(map(self.shown.__getitem__, ids))
        while (self.prefix or self.tidy) and at < len(ids):
            i = ids[at]
            if i in self.byte_of or i == self.unknown:
                break
            if shown[at].startswith(b" "):
                shown[at] = shown[at][1:]
                if not self.tidy:
                    break
            if shown[at]:
                break
            at += 1
        if self.control.isdisjoint(ids[1:-1]):
            try:
                return b"".join(shown).decode()
            except UnicodeDecodeError:
                pass
        return self._decoded_in_part(ids, shown)

    def _decoded_in_part(self, ids: list[int], shown: list[bytes]) -> str:
        """Runs of byte pieces, which any other piece ends, stand for themselves: each byte that begins no whole character becomes U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                n = next((n for n in (1, 2, 3, 4) if _is_character(run[at : at + n])), 0)
                out.append(run[at : at + n].decode() if n else REPLACED)
                at += n or 1
            run.clear()

        for i, part in zip(ids, shown, strict=True):
            if i in self.byte_of:
                run += part
            else:
                flush()
                out.append(part.decode())
        flush()
        return "".join(out)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


_models: dict[str, Model] = {}


def with_model(spark: SparkSession, path: str, step: Callable[[Model, list[str]], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A function of a text column that runs step(model, texts); the model (of a fixed size) is broadcast, so only the driver reads its file."""
    with open(path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(texts: pa.Array) -> pa.Array:
        if path not in _models:
            _models[path] = Model(shared.value)
        return step(_models[path], [t or "" for t in texts.to_pylist()])

    return on_texts(kind, run)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`row` (all columns of docs), ids with begin and end, and the first byte and the byte after the last of each id in the text."""

    def step(model: Model, texts: list[str]) -> pa.Array:
        found = model.encode(texts)
        column = lambda k, kind: pa.array([f[k] for f in found], pa.list_(kind))
        return struct_array({"ids": column(0, pa.int32()), "begins": column(1, pa.int64()), "ends": column(2, pa.int64())})

    coded = with_model(docs.sparkSession, path or model_path(), step, "struct<ids:array<int>,begins:array<bigint>,ends:array<bigint>>")
    return docs.select(F.struct("*").alias("row"), coded(F.col("text").cast("string")).alias("found")).select("row", "found.*")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of coded, with `decoded`, the text of its ids (null for none)."""
    model = Model(open(path or model_path(), "rb").read())
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if ids is None else shared.value.decode(ids) for ids in column.to_pylist()], pa.string())

    return coded.withColumn("decoded", F.arrow_udf(run, "string")("ids"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`row`, n_tokens, the SHA-256 of the ids, of the text decoded from them and of their spans (32-bit and 64-bit little-endian integers), in one pass over the texts."""

    def step(model: Model, texts: list[str]) -> pa.Array:
        n, of_ids, of_text, of_spans = [], [], [], []
        for ids, low, high in model.encode(texts):
            n.append(len(ids))
            of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            of_text.append(hashlib.sha256(model.decode(ids.tolist()).encode()).hexdigest())
            of_spans.append(hashlib.sha256(np.stack([low, high], 1).astype("<u8").tobytes()).hexdigest())
        return struct_array({"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string()), "spans_sha256": pa.array(of_spans, pa.string())})

    found = with_model(docs.sparkSession, path or model_path(), step, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,spans_sha256:string>")
    return docs.select(F.struct("*").alias("row"), found(F.col("text").cast("string")).alias("found")).select("row", "found.*")
