"""Streaming query."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.plans.apportionment import AVG_RANK
from civicspark.plans.ingest import READY, party_documents
from civicspark.plans.registry import query
from civicspark.plans.tables import EP_SEATS
from civicspark.session import shared_dir
from civicspark.sources import counts
from civicspark.streaming import live


@query("live_tally", f"""
WITH v AS (SELECT election_id, party, sum(votes)::BIGINT AS votes FROM fx_party_votes WHERE {READY} GROUP BY 1, 2),
q AS (SELECT *, votes / d::DOUBLE AS quotient FROM v, generate_series(1, {EP_SEATS}) s(d)),
r AS (SELECT *, {AVG_RANK} AS rk FROM q WINDOW w AS (PARTITION BY election_id ORDER BY quotient DESC),
                                             t AS (PARTITION BY election_id, quotient))
SELECT election_id, party, votes, sum((rk <= {EP_SEATS})::INT)::INT AS won FROM r GROUP BY 1, 2, 3""")
def live_tally(t):
    """First editions with wrong counts, then corrected second editions."""
    folder = shared_dir(t.spark)
    landing = f"{folder}/landing"
    corrected = party_documents(t).withColumn("_udgave", F.lit(2))
    wrong = F.transform(
        "Stemmer.Parti",
        lambda p: p.withField("_StemmerAntal", p["_StemmerAntal"] * (F.length(p["_Navn"]) + 1)),
    )
    first = corrected.withColumn("_udgave", F.lit(1)).withColumn(
        "Stemmer", F.struct(wrong.alias("Parti"))
    )
    for documents in (first, corrected):
        counts.write_documents(documents, landing)
        running = live.live_tally(
            t.spark, landing, f"{folder}/out", f"{folder}/progress", EP_SEATS
        )
        running.awaitTermination()
    return live.current_seats(t.spark, f"{folder}/out")
