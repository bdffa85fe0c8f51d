"""Shared helpers of the training-data operators: scratch tables, row keys, batched tokenising, components."""

from __future__ import annotations

import ctypes
import gc
import itertools
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of text that one numpy step takes at once; bounds a Python worker's memory.
STEP_BYTES = 1_000_000

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_UNRADIX = pow(_RADIX, -1, 1 << 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Separators of the two word definitions, as tables over UTF-8 bytes.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NONWORD = np.zeros(256, bool)
for _b in range(128):
    NONWORD[_b] = not (48 <= _b <= 57 or 65 <= _b <= 90 or 97 <= _b <= 122)
#: A-Z to a-z and every ASCII separator of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` to a space.
ALNUM_TABLE = bytes(32 if NONWORD[b] else _LOWER[b] for b in range(256))


#: Seconds that a finished step's events are given.
SETTLE_S = 0.5


def _is_local(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session without that setting, as in tests, gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not _is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    Spark deletes shuffle files once the driver has collected the plans that made them, so that is asked for first: what stands
    on disk is then one step's shuffles and not those of all steps before.
    """
    path = scratch(df.sparkSession, name)
    if not _is_local(df.sparkSession):
        time.sleep(SETTLE_S)  # until the events of the step before, which hold its plan, are dealt with
        gc.collect()
        df.sparkSession._jvm.System.gc()
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these frames, which nothing reads any more."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Bits of a mark: 2 MB, broadcast.
MARK_BITS = 1 << 24


def marks(values: DataFrame, column: str) -> DataFrame:
    """One row with `marks`, an array of 2^18 words of 64 bits: one bit set for every value of a column. Its size does not grow with the data."""
    place = f"pmod(xxhash64({column}), {MARK_BITS})"
    words = values.groupBy(F.expr(f"shiftright({place}, 6)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} % 64 as int))")).alias("bits"))
    out = [0] * (MARK_BITS // 64)
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return values.sparkSession.createDataFrame([(out,)], "marks array<bigint>")


def is_marked(column: str) -> Column:
    """Whether a value's bit is set in `marks`: all marked values, and few others."""
    place = f"pmod(xxhash64({column}), {MARK_BITS})"
    return F.expr(f"shiftright(marks[cast(shiftright({place}, 6) as int)], cast({place} % 64 as int)) & 1 = 1")


def row_key(seed: int = 0) -> Column:
    """One 64-bit key for doc_id and text of a row, the same for equal rows."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def row_seed(docs: DataFrame) -> int:
    """The first seed under which different rows have different keys: no key holds two values of a second hash, so 128 bits tell rows apart."""
    other = F.xxhash64(F.lit("check"), F.col("text").cast("string"), F.col("doc_id").cast("long"))
    for seed in itertools.count():
        held = docs.select(row_key(seed).alias("key"), other.alias("other")).groupBy("key").agg(F.min("other").alias("low"), F.max("other").alias("high"))
        if held.where("low != high").isEmpty():
            return seed


def packed_schema(row: StructField, more: str) -> StructType:
    """The packed column of a row, whatever the names in it, and further columns as DDL."""
    return StructType([row, *StructType.fromDDL(more).fields])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_powers: dict[str, np.ndarray] = {}


def _radix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, STEP_BYTES + STEP_BYTES // 4)
        for key, base in (("up", _RADIX), ("down", _UNRADIX)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.cumprod(steps, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """Words of a batch of texts: starts and ends are byte positions in `data`, hashes name the words, and those of text i are first[i]:first[i+1]."""

    def __init__(self, texts: list[bytes], separators: np.ndarray, lower: bool):
        joined = b" ".join(texts) + b" "
        if lower:
            joined = joined.translate(_LOWER)
        data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.empty(len(data) + 1, np.int8)
        inside[0] = 0
        inside[1:] = ~separators[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.base)
        up, down = _radix_powers(len(data))
        with np.errstate(over="ignore"):
            total = np.empty(len(data) + 1, _U)
            total[0] = 0
            np.cumsum((data.astype(_U) + _U(1)) * up, out=total[1:])
            self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(_U))


def range_hashes(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of values[low:high] for many ranges at once, whatever their lengths."""
    up, down = _radix_powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(values) + 1, _U)
        total[0] = 0
        np.cumsum((mix(values) | _U(1)) * up[:-1], out=total[1:])
        return mix((total[high] - total[low]) * down[low] + (high - low).astype(_U))


def word_hashes(texts: list[bytes], separators: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of many texts and where those of each text begin, in steps of bounded size."""
    hashes, first, low, size = [np.empty(0, _U)], [np.zeros(1, np.int64)], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= STEP_BYTES or i + 1 == len(texts):
            part = Words(texts[low : i + 1], separators, lower)
            hashes.append(part.hashes)
            first.append(part.first[1:] + first[-1][-1])
            low, size = i + 1, 0
    return np.concatenate(hashes), np.concatenate(first)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words (by the hashes of the words)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(m, _U)
        factor = 1
        for j in range(n):
            factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
            out += words[j : j + m] * _U(factor)
        return mix(out)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _let_go() -> None:
    """Give back memory of what is done: Python workers live on from task to task beside the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of a text column, one whole text at least."""
    for batch in batches:
        _let_go()
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        yield batch.slice(at)
    _let_go()


def on_texts(kind: str, step: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    """A function of a text column that works on Arrow arrays of bounded size; only the texts go to Python, the rest of the row stays where it is. kind: DDL of its type."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            parts = [step(b.column(0)) for b in steps(iter([pa.RecordBatch.from_arrays([array], ["text"])]), "text")]
            yield pa.concat_arrays(parts) if parts else step(array)

    # not to be copied into filters above: texts are worked on once
    return F.arrow_udf(run, _parsed(kind)).asNondeterministic()


def _parsed(kind: str) -> DataType:
    return StructType.fromDDL(f"x {kind}")["x"].dataType


def struct_array(columns: dict[str, pa.Array]) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b), both long: one row (v, label) per vertex, label being its component's smallest vertex.

    Labels take the least label around them and then jump to the label of their label, so long chains halve; each
    round is written to the shared folder. No edges give no rows; loops and repeated edges do no harm.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    both = stored(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), f"{name}-labels")
    while True:
        around = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("least_around"))
        lower = labels.join(around, "v").select("v", F.col("label").alias("old"), F.least("label", "least_around").alias("label"))
        jumps = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        after = stored(lower.join(jumps, "label").select("v", "old", F.least("label", "next").alias("label")), f"{name}-labels")
        labels = after.select("v", "label")
        if after.where("label != old").isEmpty():
            return labels
