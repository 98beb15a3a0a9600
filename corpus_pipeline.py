"""The corpus pipeline: from raw documents to the place of each copy in the training shards.

Each stage takes the documents its predecessor kept and decides on them alone. The stages use
the operators of ``civicspark.llm``, with a hash of each row in place of its doc_id where their
decisions are joined back; between two stages the documents are written and read
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import table
from civicspark.llm.decontam import decontaminate
from civicspark.llm.gam import quality_scores
from civicspark.llm.mixing import mix
from civicspark.llm.neardup import near_duplicates
from civicspark.llm.queries import SHARDS
from civicspark.llm.sharding import shard
from civicspark.session import materialize


#: Near duplicates share this percentage of the five-word shingles of both.
NEAR_PERCENT = 80
#: Copies of equal rows that one row of a join stands for.
CHUNK = 1000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), names=("_score", "_predicted"))
    return scored.filter("_predicted = 1").select(*docs.columns)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with ``_row``, a hash of ``columns`` and of which of them are null.

    Decisions find their rows by it: null and repeated doc_ids do not.
    """
    return docs.withColumn("_row", F.xxhash64(*columns, *(F.col(c).isNull() for c in columns)))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id, none being last.

    Of rows equal in doc_id and text one stays, of texts without words all others.
    """
    rows = keyed(docs, "doc_id", "text")
    groups = near_duplicates(rows, "_row", percent=NEAR_PERCENT).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ids = rows.select("_row", F.col("doc_id").alias("_id")).distinct()
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")
    kept = groups.distinct().join(ids, "_row").groupBy("_group").agg(first).select("first._row")
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate(keyed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"), id_col="_row").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to two times.

    Rows equal in every column are drawn one by one; as nothing tells them apart, what is taken of
    them is written out from one of them, in chunks, so that a hot row is not one task's work.
    """
    rows = keyed(docs, *docs.columns)
    drawn = mix(rows.withColumn("doc_id", F.col("_row"))).groupBy(F.col("doc_id").alias("_row")).agg(F.sum("copies").alias("_copies"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(CHUNK).cast("long")))
    chunks = drawn.filter("_copies > 0").select("_row", "_copies", starts.alias("_start"))
    one = rows.dropDuplicates(["_row"])
    taken = one.join(chunks, "_row").withColumn("_n", F.least(F.lit(CHUNK), F.col("_copies") - F.col("_start")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each copy, with everything known of it but its text."""
    known = [c for c in docs.columns if c not in ("text", "shard", "slot", "row_no")]
    rows = docs.select(*known, F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", *(c for c in ("source", "lang", "n_chars") if c in known)]
    return shard(rows, order, SHARDS).drop("row_no")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicate),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: A learnt model and MinHash have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
