"""A training corpus from documents: quality rules, near-duplicate removal, passage dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet in the shared folder and read
again as the next stage's docs. Rows with a null or empty text fail the quality rules of stage 1; the later stages keep such rows.
Of equal rows and near-duplicates one stays (stage 2), by its least doc_id, null last. An empty table stays empty. All columns but
text and n_chars are carried to stage 4 unchanged, whatever their names; the last stage returns doc_id and the tokens' digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm import bpe, decontaminate, jaccard, quality, suffixes
from quillmart.llm.common import row_key, row_seed, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs).where("kept").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: that with the least doc_id (null last), of such the one with the least row key. Empty texts all stay.

    Of rows equal in doc_id and text the one whose other columns have the least hash stays.
    """
    seed = row_seed(docs)
    rows = jaccard.near_duplicates(docs, seed).groupBy("group", "row", "doc_id").agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "n")
    heads = rows.where("group is not null").groupBy("group").agg(F.min(place).alias("head")).select("head.row", "head.n")
    empty = rows.where("group is null").select("row", F.lit(1).cast("long").alias("n"))
    kept = stored(heads.union(empty).groupBy("row").agg(F.max("n").alias("n")), "pipeline-kept")
    packed = docs.select(row_key(seed).alias("row"), F.struct("*").alias("doc"))
    once = packed.join(kept.where("n = 1"), "row", "left_semi").select("doc")
    repeated = packed.join(kept.where("n > 1"), "row", "left_semi")
    one = repeated.groupBy("row").agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc")).select("doc")
    return once.union(one).select("doc.*")


def _with_text(packed: DataFrame, struct: str, columns: list[str]) -> DataFrame:
    """The columns of documents with the new text; n_chars follows it."""
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return packed.select(*[new[c].alias(c) if c in new else F.col(struct)[c].alias(c) for c in columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of fifty words or more are cut out; a document is dropped only if nothing is left of it."""
    left = suffixes.without_copies(docs).where("doc.text is null or length(trim(text)) > 0 or length(trim(doc.text)) = 0")
    return _with_text(left, "doc", docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark phrases are cut out."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    return _with_text(decontaminate.removed(found), "row", docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens and the digests of ids and decoded bytes."""
    return bpe.round_trip(docs.select("doc_id", "text")).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", keep_quality), ("n-gram jaccard join", keep_one_of_each), ("suffix-array dedup", cut_repeats), ("benchmark decontamination", cut_benchmark), ("byte-level bpe", tokenise)]

#: SQL cannot express the tokens of the last stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return docs
