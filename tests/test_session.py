"""Where working tables go, and that their owner can remove them."""

from __future__ import annotations

from pathlib import Path

import pytest

from civicspark import session


def test_written_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", {})
    kept = session.materialize(spark.range(5))
    folder = Path(session._written[spark.sparkContext.applicationId][0])
    assert kept.count() == 5 and list(folder.glob("*.parquet"))
    assert session.drop_written(spark) == 1 and not folder.exists()
    assert session.drop_written(spark) == 0


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        applicationId = "app"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_discard_deletes_one_table(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", {})
    one, other = session.materialize(spark.range(3).toDF("x")), session.materialize(spark.range(4).toDF("x"), codec="zstd")
    files = [f.removeprefix("file://") for f in one.inputFiles()]
    session.discard(one)
    assert not any(Path(f).exists() for f in files)
    assert other.count() == 4
    session.drop_written(spark)
