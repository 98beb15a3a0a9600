"""Incremental tally of count documents that keep arriving in a landing folder.

The state is a table of current documents, one per area, with one version per election: a
micro-batch reads the version of the elections it touches, replaces the documents of the areas
that have newer ones, and writes a new version of those elections only. ``versions/batch=…``
says which version of which election holds after a batch. So a batch reads its own documents and
the areas of its elections, however many batches there have been, and superseded versions are
deleted. A batch reads nothing it writes and replaces what an earlier try of the same batch
wrote, so it can be run again after a failure. Nothing is kept on executors.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civicspark.operators.apportion import highest_averages
from civicspark.sources import counts

STATE_SCHEMA = (
    "election_id INT, area_id STRING, edition INT, parties ARRAY<STRUCT<party: STRING, votes: BIGINT>>, "
    "batch BIGINT"
)
SEATS_SCHEMA = "election_id INT, party STRING, votes BIGINT, won INT"
VERSIONS_SCHEMA = "election_id INT, version BIGINT"


def document_rows(documents: DataFrame) -> DataFrame:
    """One row per ready document: area, edition and its parties' votes."""
    parties = F.transform(
        "Stemmer.Parti",
        lambda p: F.struct(p["_Navn"].alias("party"), p["_StemmerAntal"].alias("votes")),
    )
    return counts.ready_only(documents).select(
        "election_id",
        F.col("Sted._Id").alias("area_id"),
        F.coalesce("_udgave", F.lit(0)).alias("edition"),
        parties.alias("parties"),
    )


def current_documents(documents: DataFrame) -> DataFrame:
    """The newest document of each area: highest edition, then latest batch.

    The maximum combines on the map side, so only one document per area is shuffled
    from each task.
    """
    newest = documents.groupBy("election_id", "area_id").agg(
        F.max(F.struct("edition", "batch", "parties")).alias("d")
    )
    return newest.select("election_id", "area_id", "d.edition", "d.parties", "d.batch")


def latest_votes(documents: DataFrame) -> DataFrame:
    """Votes per election and party from the newest document of each area."""
    return (
        current_documents(documents)
        .select("election_id", F.inline("parties"))
        .groupBy("election_id", "party")
        .agg(F.sum("votes").alias("votes"))
    )


def seats_of(documents: DataFrame, seats: int) -> DataFrame:
    return highest_averages(latest_votes(documents), ["election_id"], "party", "votes", seats)


class TallyState:
    """The versions of the elections below a folder."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark = spark
        self.out = out

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def last_batch(self) -> int | None:
        """The last batch whose versions are written, from the names of the folders alone."""
        files, target = self._files(f"{self.out}/versions")
        if not files.exists(target):
            return None
        found = [str(s.getPath()) for s in files.listStatus(target) if files.exists(s.getPath().suffix("/_SUCCESS"))]
        return max((int(p.rpartition("=")[2]) for p in found if "=" in p), default=None)

    def versions(self, batch: int | None) -> dict[int, int]:
        """Election -> batch that wrote its current version; as many as there are elections."""
        if batch is None or batch < 0 or not (fs := self._files(f"{self.out}/versions/batch={batch}"))[0].exists(fs[1]):
            return {}
        rows = self.spark.read.schema(VERSIONS_SCHEMA).parquet(f"{self.out}/versions/batch={batch}").collect()
        return {r.election_id: r.version for r in rows}

    def paths(self, table: str, versions: dict[int, int], elections: Iterable[int] | None = None) -> list[str]:
        """Folders of the current versions of ``elections``, or of all."""
        asked = versions if elections is None else [e for e in elections if e in versions]
        return [f"{self.out}/{table}/batch={versions[e]}/election_id={e}" for e in asked]

    def read(self, table: str, schema: str, versions: dict[int, int], elections: Iterable[int] | None = None) -> DataFrame:
        """Current rows, from the folders of the versions and no others."""
        paths = self.paths(table, versions, elections)
        if not paths:
            return self.spark.createDataFrame([], schema)
        # The batches that wrote the versions are folders too: the election is told by the path.
        election = F.regexp_extract(F.col("_metadata.file_path"), "/election_id=(-?[0-9]+)/", 1).cast("int")
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.withColumn("election_id", election)

    def write(self, rows: DataFrame, table: str, batch: int) -> None:
        """A new version of the elections in ``rows``, a folder each; an election's rows are few."""
        rows.repartition("election_id").write.mode("overwrite").partitionBy("election_id").parquet(f"{self.out}/{table}/batch={batch}")

    def commit(self, versions: dict[int, int], batch: int) -> None:
        rows = self.spark.createDataFrame(sorted(versions.items()), VERSIONS_SCHEMA).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.out}/versions/batch={batch}")

    def drop(self, old: dict[int, int], kept: dict[int, int]) -> None:
        """Delete the versions in ``old`` that ``kept`` has replaced."""
        gone = {e: v for e, v in old.items() if kept.get(e) != v}
        for table in ("documents", "seats"):
            for path in self.paths(table, gone):
                files, target = self._files(path)
                files.delete(target, True)


def live_tally(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    seats: int,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process all landed files that are new since the last run, then stop.

    ``out/documents`` has the current documents, ``out/seats`` the seats, ``out/versions`` the
    version of each election after each batch; see ``current_seats``.
    """
    reader = spark.readStream.format("xml").option("rowTag", "Data").schema(counts.PARTY_DOCUMENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def apply(batch: DataFrame, batch_id: int) -> None:
        state = TallyState(batch.sparkSession, out)
        before = state.versions(batch_id - 1)
        # the documents are parsed once; a lost executor's share is parsed again
        arrived = document_rows(batch).withColumn("batch", F.lit(batch_id).cast("bigint")).persist()
        # one id per election, of which a catalogue has a handful
        touched = sorted(r.election_id for r in arrived.select("election_id").distinct().collect())
        known = state.read("documents", STATE_SCHEMA, before, touched)
        state.write(current_documents(known.unionByName(arrived)), "documents", batch_id)
        arrived.unpersist()
        after = before | {e: batch_id for e in touched}
        current = state.read("documents", STATE_SCHEMA, after, touched)
        state.write(seats_of(current, seats), "seats", batch_id)
        state.commit(after, batch_id)
        # What this batch replaced stays until the next one has succeeded too.
        state.drop(state.versions(batch_id - 2), before)

    return (
        reader.load(landing)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_seats(spark: SparkSession, out: str) -> DataFrame:
    """Seats of each election as of the last batch that touched it."""
    state = TallyState(spark, out)
    return state.read("seats", SEATS_SCHEMA, state.versions(state.last_batch()))
