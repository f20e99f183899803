"""Session settings and shared-folder helpers used by every operator that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "terrane", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, adaptive execution and small Arrow batches; a cluster sets master and partitions itself."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named Parquet tables below sf_dir, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Own shared folders of applications whose spark.checkpoint.dir is unset, and the tables that cut() has written.
_OWN: dict[str, str] = {}
_CUTS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where it is unset, a local master gets an
    own one (tests); a cluster must name one, as executors do not see each other's disks."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="terrane-checkpoint-")
    return _OWN[context.applicationId]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once below the shared folder and read it back: lineage ends there, sizes are known to the planner,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of about so many rows, for work that is dear for each row: a compact file of very many is one task."""
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > 1 else df


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that cut() has written, by the file system that holds them."""
    jvm, known = spark.sparkContext._jvm, _CUTS.get(spark.sparkContext.applicationId, [])
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in known:
            known.remove(path)


def last_cut(spark: SparkSession) -> str:
    """The path of the table that was cut last."""
    return _CUTS[spark.sparkContext.applicationId][-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables cut within, all but the last, once what they served has been written to that one; all of them
    if that fails."""
    known = _CUTS.setdefault(spark.sparkContext.applicationId, [])
    before = set(known)
    own = lambda: [path for path in known if path not in before]
    try:
        yield
    except BaseException:
        remove(spark, own())
        raise
    remove(spark, own()[:-1])
