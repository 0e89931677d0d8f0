"""Session helpers: building a local session and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
RUN = uuid.uuid4().hex


def build_session(master: str = "local[8]", app: str = "motioncat", **conf: str) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster without it
    is refused, since executors could not share a folder of one machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="motioncat-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place below this process's own folder, which ``cleanup`` deletes as a whole."""
    return f"{shared_folder(spark)}/motioncat/run-{RUN}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all that this process has materialized; results that still read it must be written before."""
    _delete(spark, f"{shared_folder(spark)}/motioncat/run-{RUN}")


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more, such as a round's before last."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast local table if it has at most ``max_rows`` rows and ``BROADCAST_BYTES``, else ``df`` itself.

    Checks the true size, so that joining a dimension never moves the large side for want
    of an estimate, and a dimension that outgrew the bound is joined by shuffle instead.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows or sum(len(repr(r)) for r in rows) > BROADCAST_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative plans in a way that survives lost executors, and
    gives the optimizer true sizes for the next join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
