"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "civicspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    AQE coalesces small shuffles, splits skewed join partitions and switches to a
    broadcast join only after the size of that side has been measured.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders that sessions of this process have written, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder every executor can reach, below ``spark.checkpoint.dir``.

    Where that is unset it lies below the warehouse. Its default is a folder of the driver's machine, so
    a cluster must have set one of the two.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        if not local and spark.sparkContext.getConf().get("spark.sql.warehouse.dir") is None:
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all machines share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to a fresh shared folder and continue from the files.

    Used where a small result of a pass over the raw rows feeds many later steps. It cuts
    the lineage like a checkpoint, and the files also tell Catalyst their size, so joins
    with them are planned as broadcasts only if they really are small. The table stays until
    ``discard`` or ``drop_written`` removes it. ``codec`` compresses the files.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` returned.

    For the owner of a long job, once everything that reads the table is written itself: then no
    lost task can ask for it again.
    """
    spark = df.sparkSession
    held = _written.get(spark.sparkContext.applicationId, [])
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        for known in [k for k in held if k.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]]:
            _delete(spark, known)
            held.remove(known)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_written(spark: SparkSession) -> int:
    """Delete every folder ``shared_dir`` has given out to this application; returns their number.

    For the owner of a job, once its results are read or saved: results built before
    cannot be read any more.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
