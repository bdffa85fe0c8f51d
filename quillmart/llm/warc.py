"""WARC archives: written by Spark's text writer, read back in splits and checked by boundary chains.

Writing: one record per page; equal payloads of at least `least_bytes` bytes are stored once, by the smallest page_id (null last),
and the others become revisit records that refer to it. A payload is only shuffled if its digest comes more than once.

Reading: every task cuts its split at the record magic and emits candidates with the offset of their successor (header and
payload length). Inside a split candidates are joined into chains. Pointer jumping over the chains, from the start of each
file, keeps the reachable records; a magic inside a payload starts a chain that nothing reaches, and the payload that it cut is
put together again.

Null html is an empty payload, a null url an empty header field, a null page_id stays null; rows that agree in page_id, url and
html are captures of the same type. An empty table gives empty archives. Other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import is_marked, marks, scratch, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """SHA-1 in base32: every five hex digits are four base32 digits."""
    digest = F.sha1(F.encode(text, "UTF-8"))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]), _HEX32, _BASE32)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Archives under `path`. The text writer ends each record with the blank lines that WARC asks for.

    Only digests that come twice or more matter to others. Their rows are picked out by marked bits, so a row whose digest
    has none is written straight from the scan. The payload of the others goes through one join with the first of their
    digest (false marks find none there and are written as they are).
    """
    rows = pages.select(
        "page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"),
        F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("uri"), F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "uri")
    large = rows.where(F.octet_length("payload") >= least_bytes)
    firsts = stored(large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-firsts")
    told = rows.crossJoin(F.broadcast(marks(firsts, "digest"))).withColumn("marked", is_marked("digest") & (F.octet_length("payload") >= least_bytes)).drop("marks")
    none = F.lit(None).cast(firsts.schema["first"].dataType)
    alone = told.where("not marked").select("id", "uri", "payload", "digest", F.lit(False).alias("revisit"), none.alias("first"))
    shared = told.where("marked").join(firsts, "digest", "left").select("id", "uri", "payload", "digest", F.coalesce(order != F.col("first"), F.lit(False)).alias("revisit"), "first")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), "id", F.lit(">"))), line("WARC-Target-URI", F.col("uri")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("X-Payload-Length", F.octet_length("payload").cast("string")),
        F.when(F.col("revisit"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.lit(">")))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"), F.lit("Content-Length: "), F.when(F.col("revisit"), "0").otherwise(F.octet_length("payload").cast("string")), F.lit(END),
    )
    records = alone.union(shared).select(F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("payload"))).alias("value"))
    records.write.option("lineSep", END).text(path)


_FIELD = re.compile(rb"(?m)^([A-Za-z-]+): ?([^\r\n]*)\r?$")
_CANDIDATE = (
    "file string, split long, at long, bytes long, successor long, chain long, whole boolean, page_id long, record_type string, refers_to long, uri string, "
    "payload_bytes long, payload_digest string, raw binary"
)
_NAMES = [f.split()[0] for f in _CANDIDATE.split(", ")]


def _number(value: bytes) -> int | None:
    found = re.search(rb":(-?\d+)>$", value)
    return int(found[1]) if found else None


def _payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse(raw: bytes) -> dict | None:
    """Fields of a record without its magic; None if it has no header with a length. `size` counts the magic and the end."""
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(raw[: cut + 2])}
    if not fields.get(b"content-length", b"").isdigit() or b"warc-type" not in fields:
        return None
    length = int(fields[b"content-length"])
    payload = raw[cut + 4 : cut + 4 + length]
    stated = fields.get(b"x-payload-length", b"")
    revisit = fields[b"warc-type"] == b"revisit"
    return {
        "size": len(MAGIC) + cut + 4 + length + len(END), "whole": len(raw) == cut + 4 + length + len(END), "page_id": _number(fields.get(b"warc-record-id", b"")), "record_type": fields[b"warc-type"].decode(),
        "refers_to": _number(fields.get(b"warc-refers-to", b"")), "uri": fields.get(b"warc-target-uri", b"").decode(),
        "payload_bytes": int(stated) if revisit and stated.isdigit() else length, "payload_digest": fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") if revisit else _payload_digest(payload),
    }


def _chains(rows: list[dict]) -> None:
    """Name each candidate of a split by the head of its chain: the first candidate, in file order, that leads to it."""
    by_offset = {r["at"]: r for r in rows}
    for r in rows:
        r.setdefault("chain", r["at"])
        if r["successor"] is not None and (to := by_offset.get(r["successor"])) and to["at"] > r["at"]:
            to.setdefault("chain", r["chain"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets count from the split's first byte that it owns; the splits' places in the file are added later."""
    now, at, rows = None, 0, []

    def ready() -> Iterator[pa.RecordBatch]:
        _chains(rows)
        for i in range(0, len(rows), 500):
            part = rows[i : i + 500]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in part], t) for n, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)

    for batch in batches:
        for file, split, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), strict=True):
            if (file, split) != now:
                yield from ready()
                now, at, rows = (file, split), 0, []
            size = len(raw) + len(MAGIC)
            found = parse(raw) or {"whole": False}
            successor = at + found.pop("size") if "size" in found else None
            rows.append({"file": file, "split": split, "at": at, "bytes": size, "successor": successor, **found} | ({} if found["whole"] else {"raw": raw}))
            at += size
    yield from ready()


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the magic in the archives, stored, with absolute offsets."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    # the piece before the first magic of a file has no magic of its own
    raw = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    found = stored(raw.mapInArrow(_candidates, _CANDIDATE), "warc-candidates")
    sizes = found.groupBy("file", "split").agg(F.sum("bytes").alias("split_bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "split", (F.coalesce(F.sum("split_bytes").over(before), F.lit(0)) - len(MAGIC)).alias("base"))
    placed = found.join(base, ["file", "split"])
    shift = lambda c: (F.col(c) + F.col("base")).alias(c)
    return placed.select("file", *(shift(c) if c in ("at", "successor", "chain") else c for c in _NAMES[2:]))


def reachable(found: DataFrame) -> DataFrame:
    """(file, chain, entry): the chains that the start of their file reaches, and where; by pointer jumping over chains."""
    heads = found.where("successor is not null").select("file", "chain", "at", "successor")
    last = heads.groupBy("file", "chain").agg(F.max_by("successor", "at").alias("at"))
    jumps = stored(last.join(heads.select("file", "at", F.col("chain").alias("to")), ["file", "at"]).select("file", "chain", "to", F.col("at").alias("entry")).where("to != chain"), "warc-jumps")
    reached = stored(heads.where("at = 0").select("file", "chain", F.col("at").alias("entry")), "warc-reached")
    n = reached.count()
    while True:
        further = reached.select("file", "chain").join(jumps, ["file", "chain"]).select("file", F.col("to").alias("chain"), "entry")
        reached = stored(reached.union(further).groupBy("file", "chain").agg(F.min("entry").alias("entry")), "warc-reached")
        if (after := reached.count()) == n:
            return reached
        n = after
        on = jumps.select("file", F.col("chain").alias("to"), F.col("to").alias("then"), F.col("entry").alias("there"))
        jumps = stored(jumps.join(on, ["file", "to"]).select("file", "chain", F.col("then").alias("to"), F.col("there").alias("entry")), "warc-jumps")


def _rebuilt(key: tuple, pieces: pa.Table) -> pa.Table:
    """A payload that an inner magic cut: its pieces joined in file order."""
    raw = MAGIC.encode().join(pieces.sort_by("at").column("raw").to_pylist())
    found = parse(raw) or {}
    return pa.table({n: pa.array([found.get(n)], t) for n, t in zip(_NAMES, _TYPES, strict=True) if n in _RECORD})


_RECORD = ["page_id", "record_type", "refers_to", "uri", "payload_bytes", "payload_digest"]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, uri, payload_bytes and payload_digest of every true record."""
    found = candidates(spark, path).where("at >= 0")
    marked = found.join(reachable(found), ["file", "chain"], "left").withColumn("true", F.coalesce(F.col("at") >= F.col("entry"), F.lit(False)))
    whole = marked.where("true and whole").select(*_RECORD)
    torn = marked.where("true and not whole").select("file", F.col("at").alias("owner"), F.col("successor").alias("until"))
    # pieces lie between a torn record and its successor; few, so the owner is found by a window over the torn files alone
    pieces = marked.where("not whole or not true").join(torn.select("file").distinct(), "file", "left_semi")
    along = Window.partitionBy("file").orderBy("at")
    owner = lambda c: F.last(F.when(F.col("true") & ~F.col("whole"), F.col(c)), ignorenulls=True).over(along)
    owned = pieces.withColumn("owner", owner("at")).withColumn("until", owner("successor")).where("at < until")
    schema = ", ".join(f for f in _CANDIDATE.split(", ") if f.split()[0] in _RECORD)
    order = [f.split()[0] for f in schema.split(", ")]
    return whole.select(order).union(owned.select("file", "owner", "at", "raw").groupBy("file", "owner").applyInArrow(_rebuilt, schema))


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages to archives in the shared folder and read the records back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path)
