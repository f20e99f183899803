"""Sinks: staged replacement with a row-count invariant, keyed replacement, and a ledger of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "run_id string, name string, status string, at timestamp, rows long, source_digest string"


class RowCountError(RuntimeError):
    """A staged table has not the rows that were announced."""


def replace_table(df: DataFrame, path: str, expected: int | None = None) -> int:
    """Write beside the table, count what arrived, then move it into place; the old table stays if anything fails."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    rows = spark.read.parquet(staged).count()
    if expected is not None and rows != expected:
        raise RowCountError(f"staged {rows} rows, expected {expected}")
    jvm = spark.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = f"{path.rstrip('/')}__old-{uuid.uuid4().hex}"
    had = files.exists(place(path))
    if had and not files.rename(place(path), place(aside)):
        raise OSError(f"could not move {path} aside; the staged table is {staged}")
    if not files.rename(place(staged), place(path)):
        back = not had or files.rename(place(aside), place(path))
        raise OSError(f"could not move {staged} to {path}; the old table is {path if back else aside}")
    if had:
        files.delete(place(aside), True)
    return rows


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same keys, the others stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def log_run(spark: SparkSession, path: str, run_id: str, name: str, status: str, rows: int | None = None, digest: str | None = None) -> None:
    """Append a line to the ledger of runs: started, succeeded, failed or abandoned."""
    line = spark.createDataFrame([(run_id, name, status, rows, digest)], "run_id string, name string, status string, rows long, source_digest string")
    line.select("run_id", "name", "status", F.current_timestamp().alias("at"), "rows", "source_digest").coalesce(1).write.mode("append").parquet(path)


def latest_run(ledger: DataFrame, name: str, status: str = "succeeded") -> DataFrame:
    """The newest run of a name with a status, as one row or none."""
    return ledger.where((F.col("name") == name) & (F.col("status") == status)).orderBy(F.desc("at"), F.desc("run_id")).limit(1)


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order, equal for equal contents: for skipping unchanged input."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), F.lit(1))).alias("x")).first()
    return f"{row.n}-{row.s}-{row.x}"


def latest_runs(ledger: DataFrame, status: str = "succeeded") -> DataFrame:
    """(name, run_id, at): the newest run of each name with a status."""
    newest = F.max_by(F.struct("run_id", "at"), F.struct("at", "run_id")).alias("r")
    return ledger.where(F.col("status") == status).groupBy("name").agg(newest).select("name", "r.run_id", "r.at")


def stale(ledger: DataFrame, name: str, source: str) -> DataFrame:
    """Whether the newest success of a name is older than that of what it is built from, or missing: one row."""
    newest = latest_runs(ledger)
    own, base = (F.max(F.when(F.col("name") == n, F.col("at"))) for n in (name, source))
    return newest.agg(own.alias("built"), base.alias("source")).withColumn("stale", F.col("source").isNotNull() & (F.col("built").isNull() | (F.col("built") < F.col("source"))))


def abandoned(ledger: DataFrame, name: str, older_than: Column) -> DataFrame:
    """(run_id, at): runs of a name that were started before a time and have not ended; log them as abandoned."""
    runs = ledger.where(F.col("name") == name).groupBy("run_id").agg(F.min(F.when(F.col("status") == "started", F.col("at"))).alias("at"), F.count_if(F.col("status") != "started").alias("ends"))
    return runs.where((F.col("ends") == 0) & (F.col("at") < older_than)).select("run_id", "at")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small report (thresholds, metrics of each query) as one CSV or JSON file in a folder, replacing what was there."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)
