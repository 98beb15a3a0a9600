"""Election count documents (XML): manifests, party votes, candidate votes, electorates.

Files are landed by another system, one or more documents per file, in folders
``election_id=…``. Schemas are declared, so nothing is inferred and a repeat with one
element is still a list. Reading is per document; no step shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.sources import fixed_values as fixed

PARTY = (
    "STRUCT<_Id: STRING, _Bogstav: STRING, _Navn: STRING, _StemmerAntal: BIGINT, "
    "_StemmerPct: STRING>"
)
PERSON = (
    "STRUCT<_Navn: STRING, _PersonligeStemmer: BIGINT, _TildeltePartiStemmer: BIGINT, "
    "_StemmerIAlt: BIGINT>"
)
PERSON_PARTY = (
    "STRUCT<_Id: STRING, _Bogstav: STRING, _navn: STRING, _PersonligeStemmer: BIGINT, "
    f"_TildeltePartiStemmer: BIGINT, _StemmerIAlt: BIGINT, Person: ARRAY<{PERSON}>>"
)
HEAD = (
    "election_id INT, _udgave INT, Status STRUCT<_Kode: STRING, _VALUE: STRING>, "
    "Sted STRUCT<_Id: STRING, _VALUE: STRING>"
)
PARTY_DOCUMENT = f"{HEAD}, Stemmer STRUCT<Parti: ARRAY<{PARTY}>>"
PERSON_DOCUMENT = f"{HEAD}, Personer STRUCT<Parti: ARRAY<{PERSON_PARTY}>>"
ELECTORATE_DOCUMENT = f"{HEAD}, Stemmeberettigede BIGINT"


def check_request(level: str, kind: str = "parti", national_persons: bool = False) -> str:
    """Lower-cased level, or ``ValueError`` before any job runs.

    Personal votes exist below the regions only, unless ``national_persons``.
    """
    level, kind = level.lower(), kind.lower()
    if kind not in ("parti", "person"):
        raise ValueError("kind must be 'parti' or 'person'")
    if level not in fixed.LEVELS:
        raise ValueError(f"level must be one of {', '.join(fixed.LEVELS)}")
    if kind == "person" and not national_persons and level not in fixed.PERSON_LEVELS:
        raise ValueError(f"personal votes exist for {', '.join(fixed.PERSON_LEVELS)} only")
    return level


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per ``Data`` element with the declared fields."""
    return spark.read.format("xml").option("rowTag", "Data").schema(schema).load(path)


def ready_only(documents: DataFrame) -> DataFrame:
    """Documents whose status does not say that the result is missing."""
    status = F.coalesce(F.col("Status._VALUE"), F.lit(""))
    return documents.where(status != fixed.NOT_READY)


def is_ready(documents: DataFrame) -> bool:
    """Whether any document has a result (reads until the first one)."""
    return not ready_only(documents).isEmpty()


def read_manifest(
    spark: SparkSession, path: str, level: str | Sequence[str], nth: int | None = None
) -> DataFrame:
    """Areas of one level or several: id, parent id, name and the file of their result.

    All levels come out of one parse of the documents. ``nth`` keeps one entry per document and
    level (from 0): manifests of election night list the country more than once, and the second
    entry names its result.
    """
    asked = [check_request(name) for name in ([level] if isinstance(level, str) else level)]
    fields, entries = [], []
    for container, element, area, parent in (fixed.LEVELS[name] for name in asked):
        attributes = [f"_{area}: STRING", "_filnavn: STRING", "_VALUE: STRING"]
        if parent:
            attributes.append(f"_{parent}: STRING")
        node = f"ARRAY<STRUCT<{', '.join(attributes)}>>"
        fields.append(f"{container} STRUCT<{element}: {node}>" if container else f"{element} {node}")
        nodes = F.col(f"{container}.{element}" if container else element)
        nodes = F.slice(nodes, nth + 1, 1) if nth is not None else nodes
        entries.append(_manifest_entries(nodes, area, parent))
    documents = read_documents(spark, path, f"election_id INT, ValgDato STRING, {', '.join(fields)}")
    return documents.select("election_id", F.inline(F.concat(*entries)))


def _manifest_entries(nodes: Column, area: str, parent: str | None) -> Column:
    """A level's nodes in the common form; none where a document lacks the level."""
    form = "array<struct<area_id:string,parent_id:string,name:string,file:string>>"
    found = F.transform(
        nodes,
        lambda a: F.struct(
            a[f"_{area}"].alias("area_id"),
            (a[f"_{parent}"] if parent else F.lit(None).cast("string")).alias("parent_id"),
            F.trim(a["_VALUE"]).alias("name"),
            a["_filnavn"].alias("file"),
        ),
    )
    return F.coalesce(found, F.array()).cast(form)


def flatten_party_votes(documents: DataFrame) -> DataFrame:
    """One row per place and party; the place rides along with the exploded party."""
    return ready_only(documents).select(
        "election_id", "Sted", F.explode("Stemmer.Parti").alias("p")
    ).select(
        "election_id",
        F.col("Sted._Id").alias("area_id"),
        F.col("Sted._VALUE").alias("area"),
        F.col("p._Id").alias("party_id"),
        F.col("p._Bogstav").alias("letter"),
        F.col("p._Navn").alias("party"),
        F.col("p._StemmerAntal").alias("votes"),
    )


def read_party_votes(spark: SparkSession, path: str, level: str = "storkredse") -> DataFrame:
    """Party votes of the documents of one level."""
    check_request(level)
    return flatten_party_votes(read_documents(spark, path, PARTY_DOCUMENT))


def flatten_candidate_votes(documents: DataFrame) -> DataFrame:
    """One row per place, party and person.

    A party without persons is an independent: the party node carries the candidate's
    attributes, the letter is NULL and the party name a constant.
    """
    parties = ready_only(documents).select(
        "election_id", "Sted", F.explode("Personer.Parti").alias("p")
    )
    persons = parties.select("*", F.explode_outer("p.Person").alias("k"))
    alone = F.coalesce(F.size("p.Person"), F.lit(0)) <= 0

    def vote(name: str) -> Column:
        return F.coalesce(F.col(f"k.{name}"), F.col(f"p.{name}"))

    return persons.select(
        "election_id",
        F.col("Sted._Id").alias("area_id"),
        F.when(~alone, F.col("p._Bogstav")).alias("letter"),
        F.when(alone, fixed.INDEPENDENT).otherwise(F.col("p._navn")).alias("party"),
        F.coalesce("k._Navn", "p._navn").alias("candidate"),
        vote("_PersonligeStemmer").alias("personal_votes"),
        vote("_TildeltePartiStemmer").alias("allotted_votes"),
        vote("_StemmerIAlt").alias("total_votes"),
        F.when(~alone, F.col("p._TildeltePartiStemmer")).alias("party_allotted_votes"),
        alone.alias("independent"),
    )


def read_candidate_votes(
    spark: SparkSession, path: str, level: str = "storkredse", national_persons: bool = False
) -> DataFrame:
    """Candidate votes of the documents of one level."""
    check_request(level, "person", national_persons)
    return flatten_candidate_votes(read_documents(spark, path, PERSON_DOCUMENT))


def read_electorate(spark: SparkSession, path: str) -> DataFrame:
    """Number of people entitled to vote, per area document."""
    return read_documents(spark, path, ELECTORATE_DOCUMENT).select(
        "election_id",
        F.col("Sted._Id").alias("area_id"),
        F.col("Stemmeberettigede").alias("voters"),
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """Add documents in the landed layout, one folder per election."""
    (
        documents.write.mode("append")
        .format("xml")
        .option("rowTag", "Data")
        .option("rootTag", "Valg")
        .partitionBy("election_id")
        .save(path)
    )
