"""Tables that plans write once and read many times."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On a local master, where all share one machine, a private default stands
    in; a cluster must name one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/barloom-checkpoints"


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Cuts lineage: df as Parquet in the shared folder, read back; a lost executor then costs one re-read, and expensive
    Python stages run once however often the result is used. ``instead_of``, a result of this function that nothing reads
    any more once df is written, is deleted. All tables of an application lie in one folder of its id, which
    may go when the application has ended: results are read from it until then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/barloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    for paths in _open:
        paths.append(path)
    if instead_of is not None:
        delete(spark, [instead_of.written_at])
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of ``written``; one that has gone already is no fault."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tables():
    """The paths of the tables that are written inside. They may be deleted once what was built from them has been written or
    taken."""
    mine: list[str] = []
    _open.append(mine)
    try:
        yield mine
    finally:
        # not remove(): lists compare by content
        _open[:] = [paths for paths in _open if paths is not mine]
