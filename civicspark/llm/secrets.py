"""Secret scans: a ledger of content-addressed blobs, each met by each version of a rule once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.llm.common import sieve
from civicspark.session import materialize


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches are secrets.

    A match counts if its ``group`` has ``least`` code points or more. Every text with a match
    that counts holds ``hint`` (the pattern itself where that is None). A changed rule gets a new
    ``version``, so that the ledger sends all blobs through it again.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None


_ASSIGNED = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: Matches of the two last patterns reach to the end of a run of their letters, and later ones in
#: the same run would be shorter: a least length in the pattern drops the same matches as a
#: test afterwards. In the first one it would let a match begin inside a dropped one.
BASE_RULES = (
    Rule("assign", 1, rf"(?i:{_ASSIGNED})([A-Za-z0-9+/_.=-]+)", 2, 6, rf"(?i:{_ASSIGNED})[A-Za-z0-9+/_.=-]{{6}}"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Secrets that show by their form alone.
FORM_RULES = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + FORM_RULES


@dataclass(frozen=True)
class Ledger:
    """What has been scanned and found, for the next scan to take up.

    ``scanned``: (blob, rule, version) of every pair done, with findings or without.
    ``findings``: (blob, rule, version, start, end) in code points, ``end`` exclusive.
    """

    scanned: DataFrame
    findings: DataFrame

    def save(self, folder: str) -> Ledger:
        """Written to a folder that is new; findings first, so that no pair counts as done without them."""
        self.findings.write.parquet(f"{folder}/findings")
        self.scanned.write.parquet(f"{folder}/scanned")
        return Ledger.load(self.scanned.sparkSession, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Ledger:
        return cls(spark.read.parquet(f"{folder}/scanned"), spark.read.parquet(f"{folder}/findings"))


def _matches(text: Column, rule: Rule) -> Column:
    """All matches of a rule in their order, each with the gap before it."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    found = F.transform(
        parts,
        lambda x, i: F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.version).alias("version"),
            i.alias("pos"),
            F.char_length(x["gap"]).cast("long").alias("gap"),
            F.char_length(x["hit"]).cast("long").alias("size"),
            (F.char_length(x["part"]) >= rule.least).alias("counts"),
        ),
    )
    return F.filter(found, lambda x: x["size"].isNotNull())  # the text after the last match has none


def _scan(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of the blobs (blob, text, known): the rules named in ``known`` are left out."""
    found = [
        F.when(
            ~F.array_contains("known", F.lit(rule.name)) & F.col("text").rlike(rule.hint or rule.pattern),
            _matches(F.col("text"), rule),
        ).otherwise(F.filter(_matches(F.lit(""), rule), lambda x: F.lit(False)))
        for rule in rules
    ]
    hits = blobs.select("blob", F.explode(F.concat(*found)).alias("hit")).select("blob", "hit.*")
    # Gaps and matches of a text follow each other, so its positions are running sums.
    upto = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return (
        hits.withColumn("end", end)
        .filter("counts")
        .select("blob", "rule", "version", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def scan_history(
    versions: DataFrame,
    id_cols: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
    ledger: Ledger | None = None,
) -> tuple[DataFrame, Ledger]:
    """The secrets of every version of every path, and the ledger to save with this scan in it.

    ``versions`` has one row per version, named by ``id_cols`` (a path, a commit). Its text is
    addressed by its SHA-256; only pairs of a blob and a rule's version that ``ledger`` does not
    hold are scanned, each blob once however many versions have it. The report has
    one row per row of ``versions``: ``id_cols``, ``blob`` and ``spans``, an array of (start,
    order, rule, end) in code points, by start and then in the order of ``rules``; none gives an
    empty array. Rows that repeat are all reported. A null text is empty, null ids stay. Other
    columns are ignored, whatever their names.

    Texts are shuffled only where their blob comes more than once or is in the ledger (or a
    sieve of fixed size takes it for such); the others are scanned where they are read. The
    ledger's ``scanned`` is counted up when it is saved.
    """
    ids = [F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)]
    named = [F.col(f"_id{i}").alias(c) for i, c in enumerate(id_cols)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(*ids, text.alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = materialize(rows.drop("text"))

    # The place of a rule's version among the asked ones, 0 where it is none of them.
    order = F.array_position(
        F.array(*(F.lit(f"{r.name} {r.version}") for r in rules)), F.concat_ws(" ", "rule", F.col("version").cast("string"))
    ).cast("int")
    blobs = paths.groupBy("blob").agg(F.count("*").alias("n"))
    meet_again = blobs.filter("n > 1").select("blob")
    none = F.array().cast("array<string>")
    if ledger:
        known = materialize(ledger.scanned.filter(order > 0).groupBy("blob").agg(F.collect_set("rule").alias("known")))
        meet_again = meet_again.unionByName(known.select("blob"))
    shared = sieve(meet_again, "blob")
    texts = rows.select("blob", "text")
    alone = texts.filter(~shared(F.col("blob"))).withColumn("known", none)
    rest = texts.filter(shared(F.col("blob"))).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger:
        rest = rest.join(known, "blob", "left").withColumn("known", F.coalesce("known", none))
    else:
        rest = rest.withColumn("known", none)
    new = materialize(_scan(alone.unionByName(rest), rules))

    every = blobs.select("blob", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))).alias("r"))
    scanned = every.select("blob", "r.*")
    findings = new
    if ledger:
        scanned = scanned.unionByName(ledger.scanned.select("blob", "rule", "version")).distinct()
        findings = ledger.findings.select("blob", "rule", "version", "start", "end").unionByName(new)

    span = F.struct("start", "order", "rule", "end")
    by_blob = (
        findings.withColumn("order", order)
        .filter("order > 0")
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(span)).alias("spans"))
    )
    empty = F.array().cast("array<struct<start:bigint,order:int,rule:string,end:bigint>>")
    report = paths.join(by_blob, "blob", "left").select(*named, "blob", F.coalesce("spans", empty).alias("spans"))
    return report, Ledger(scanned, findings)


def spans_text(spans: Column) -> Column:
    """Spans as rule:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
