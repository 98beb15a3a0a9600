"""The incremental tally."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators.apportion import highest_averages
from civicspark.sources import counts
from civicspark.streaming import live

DOCUMENT = """<Data udgave="{edition}"><Status Kode="1">{status}</Status><Sted Id="{area}">x</Sted>
<Stemmer>{parties}</Stemmer></Data>"""


def document(area, edition, votes, status="Optællingen er afsluttet."):
    parties = "".join(f'<Parti Id="{p}" Bogstav="{p}" Navn="{p}" StemmerAntal="{v}"/>' for p, v in votes.items())
    return DOCUMENT.format(area=area, edition=edition, status=status, parties=parties)


def put(folder, election, name, text):
    target = folder / f"election_id={election}"
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_text(text, encoding="utf-8")


def state(spark, out):
    return sorted((r.election_id, r.party, r.votes, r.won) for r in live.current_seats(spark, out).collect())


def test_incremental_equals_batch(spark, tmp_path):
    landing, out, progress = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "progress")

    def run(**options):
        live.live_tally(spark, str(landing), out, progress, 7, **options).awaitTermination()
        return state(spark, out)

    put(landing, 1, "a.xml", document(1, 1, {"A": 50, "B": 20}))
    put(landing, 1, "b.xml", document(2, 1, {"A": 5, "B": 9}))
    put(landing, 2, "c.xml", document(1, 1, {"A": 1, "C": 3}))
    first = run(files_per_batch=1)
    assert [(e, p, v) for e, p, v, _ in first] == [(1, "A", 55), (1, "B", 29), (2, "A", 1), (2, "C", 3)]

    # a correction, a late old edition and a document that is not ready
    put(landing, 1, "d.xml", document(1, 3, {"A": 10, "B": 80}))
    put(landing, 1, "e.xml", document(1, 2, {"A": 999, "B": 999}))
    put(landing, 1, "f.xml", document(2, 4, {"A": 7}, "Resultatet foreligger endnu ikke."))
    second = run()
    assert [(e, p, v) for e, p, v, _ in second if e == 1] == [(1, "A", 15), (1, "B", 89)]
    # election 2 was not touched
    assert [r for r in second if r[0] == 2] == [r for r in first if r[0] == 2]
    assert run() == second

    documents = counts.read_documents(spark, str(landing), counts.PARTY_DOCUMENT)
    log = live.document_rows(documents).withColumn("batch", F.lit(0))
    batch = highest_averages(live.latest_votes(log), ["election_id"], "party", "votes", 7)
    assert second == sorted((r.election_id, r.party, r.votes, r.won) for r in batch.collect())


def versions_on_disk(out):
    return sorted(str(p.relative_to(out)) for p in out.glob("documents/batch=*/election_id=*"))


def test_a_batch_reads_the_areas_it_touches_only(spark, tmp_path):
    landing, out, progress = tmp_path / "landing", tmp_path / "out", str(tmp_path / "progress")
    for n in range(8):
        put(landing, 1, f"{n}.xml", document(n % 3, n, {"A": 10 + n, "B": 20}))
        if n == 0:
            put(landing, 2, "other.xml", document(1, 1, {"A": 1, "C": 3}))
        live.live_tally(spark, str(landing), str(out), progress, 7).awaitTermination()
        # No more than the current version of each election and the one before it is kept.
        assert len(versions_on_disk(out)) <= 3
    tally = live.TallyState(spark, str(out))
    versions = tally.versions(tally.last_batch())
    assert versions == {1: 7, 2: 0}
    assert tally.paths("documents", versions, [1]) == [f"{out}/documents/batch=7/election_id=1"]
    documents = tally.read("documents", live.STATE_SCHEMA, versions)
    assert sorted((r.election_id, r.area_id, r.edition) for r in documents.collect()) == [
        (1, "0", 6), (1, "1", 7), (1, "2", 5), (2, "1", 1)
    ]
    assert [(e, p, v) for e, p, v, _ in state(spark, str(out)) if e == 1] == [(1, "A", 48), (1, "B", 60)]


def test_a_batch_run_again_leaves_the_same_state(spark, tmp_path):
    landing, out, progress = tmp_path / "landing", tmp_path / "out", tmp_path / "progress"

    def run():
        live.live_tally(spark, str(landing), str(out), str(progress), 7).awaitTermination()
        return state(spark, str(out))

    put(landing, 1, "a.xml", document(1, 1, {"A": 50, "B": 20}))
    run()
    put(landing, 1, "b.xml", document(2, 1, {"A": 5, "B": 9}))
    second = run()
    # The second batch failed after its writes: it comes again.
    for commit in (progress / "commits").glob("*1*"):
        commit.unlink()
    assert run() == second
    assert live.current_seats(spark, str(tmp_path / "nothing")).isEmpty()
