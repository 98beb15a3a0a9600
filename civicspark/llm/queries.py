"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession

from civicspark.llm import oracles
from civicspark.llm.common import held_out, table
from civicspark.llm.decontam import contained_items
from civicspark.llm.gam import quality_scores
from civicspark.llm.imatch import fingerprints
from civicspark.llm.licences import scan, templates
from civicspark.llm.lines import duplicate_lines
from civicspark.llm.mixing import mix
from civicspark.llm.neardup import near_duplicates
from civicspark.llm.ranked import ranked_search
from civicspark.llm.secrets import BASE_RULES, FORM_RULES, scan_history, spans_text
from civicspark.llm.sharding import shard
from civicspark.llm.tokens import token_counts
from civicspark.llm.toxicity import toxicity
from civicspark.llm.trie import branched, prefix_trie, sequences


#: Documents with more tokens than this are flagged.
TOKEN_LIMIT = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers  # only this query needs the vocabularies

        path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts(table(spark, sf_dir, "documents"), path)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


#: Shards of the corpus.
SHARDS = 24


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(rows, ["doc_id", "text_crc32", "size"], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The documents as files: a tree of their source and the thousands and hundreds of their ids.
    # By a hash of the id, a tenth lies directly in its source and a tenth in its thousand.
    thousand, hundred, name = (F.floor(F.col("doc_id") / d).cast("string") for d in (1000, 100, 1))
    level = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    path = F.concat_ws(
        "/", F.coalesce("source", F.lit("unknown")), F.when(level > 0, thousand), F.when(level > 1, hundred), name
    )
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return scan(files, templates(spark)).withColumnRenamed("file_id", "doc_id")


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source"
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.transform("offending", lambda o: F.struct(o["start"], o["end"], o["chance"])).alias("offending"),
    )


#: Code points of a shingle of a line: one changed letter leaves lines of 29 and more linked.
LINE_POINTS = 3


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(table(spark, sf_dir, "documents"), points=LINE_POINTS)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(branched(sequences(table(spark, sf_dir, "conversations"))))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = scan_history(table(spark, sf_dir, "documents"))

    def of(*names: str):
        return F.filter("spans", lambda s: s["rule"].isin(*names))

    base = spans_text(of(*(r.name for r in BASE_RULES)))
    return report.select(
        "doc_id",
        *(F.size(of(r.name)).cast("long").alias(f"n_{r.name}") for r in BASE_RULES),
        F.sha2(base, 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        "blob",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_imatch_fingerprints": op2_imatch_fingerprints,
    "op3_feistel_sharding": op3_feistel_sharding,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_licence_scan": op6_licence_scan,
    "op7_pareto_mixing": op7_pareto_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_fuzzy_line_dedup": op9_fuzzy_line_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_secret_ledger": op13_secret_ledger,
}

ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": r"""
WITH words(kind, id, w) AS (
    SELECT 0, doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM documents
    UNION ALL
    SELECT 1, item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark
),
shingles AS (
    SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM words WHERE len(w) > 0
),
items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE kind = 1)
SELECT d.id AS doc_id, item_id, CAST(n_item AS INT) AS n_item, CAST(count(*) AS INT) AS n_shared
FROM items JOIN shingles d ON d.kind = 0 AND d.s = items.s
GROUP BY d.id, item_id, n_item
HAVING count(*) * 100 >= n_item * 80
""",
    "op11_prefix_trie": oracles.TRIE,
    "op12_ranked_search": oracles.RANKED,
    "op13_secret_ledger": oracles.secret_spans(BASE_RULES, FORM_RULES),
}
