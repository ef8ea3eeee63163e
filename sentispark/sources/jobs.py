"""The stored job table: snapshots, the newest complete one counts.

A change reads the newest snapshot, writes the next one whole and leaves the one before for readers
that have it open; older ones go. A crash leaves an incomplete folder that no reader sees and the
next change overwrites. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.operators.lifecycle import update_status
from sentispark.scale import join_per_key


def _folder(spark: SparkSession, path: str):
    """The table's folder and its file system, as Spark sees them."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    numbers = sorted(int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-"))
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [n for n in numbers if files.exists(done(f"{path}/snapshot-{n}/_SUCCESS"))]


def read_jobs(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest snapshot, or None before the first."""
    found = _snapshots(spark, path)
    return spark.read.parquet(f"{path}/snapshot-{found[-1]}") if found else None


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Make ``jobs`` the next snapshot."""
    spark = jobs.sparkSession
    found = _snapshots(spark, path)
    jobs.write.mode("overwrite").parquet(f"{path}/snapshot-{found[-1] + 1 if found else 0}")
    files, _ = _folder(spark, path)
    for old in found[:-1]:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot-{old}"), True)


def create_jobs(new: DataFrame, path: str) -> None:
    """Add jobs; an id that is stored already, or comes twice, fails the whole call."""
    stored = read_jobs(new.sparkSession, path)
    if not new.groupBy("job_id").count().filter("count > 1").isEmpty():
        raise ValueError("a job id comes twice")
    if stored is not None:
        if not join_per_key(new.select("job_id"), stored.select("job_id"), "job_id", "left_semi").isEmpty():
            raise ValueError("a job is stored already")
        new = stored.unionByName(new)
    write_jobs(new, path)


def set_status(spark: SparkSession, path: str, updates: DataFrame, at: Column) -> None:
    """Set the status of the listed jobs, the latest update of each; unknown ids change nothing."""
    write_jobs(update_status(read_jobs(spark, path), updates, at), path)


def delete_jobs(spark: SparkSession, path: str, jobs: DataFrame) -> int:
    """Delete the listed jobs; returns how many there were."""
    stored = read_jobs(spark, path)
    kept = join_per_key(stored, jobs.select("job_id").distinct(), "job_id", "left_anti")
    before = stored.count()
    write_jobs(kept, path)
    return before - read_jobs(spark, path).count()


def find_jobs(spark: SparkSession, path: str, job_id: int | str) -> DataFrame:
    return read_jobs(spark, path).filter(F.col("job_id") == F.lit(job_id))
