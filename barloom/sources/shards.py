"""Results written shard by shard, so that a run that was stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(rows: DataFrame, path: str, keys: list[str]) -> None:
    """``rows`` as Parquet with a folder for each value of ``keys``; shards that are there are replaced, others stay. The
    folders appear when the job commits, so a job that was stopped leaves none half written."""
    rows.repartition(*keys).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)


def remaining(todo: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows of ``todo`` (keys and what else they need) whose shards aren't written."""
    try:
        done = todo.sparkSession.read.parquet(path).select(*keys).distinct()
    except AnalysisException:  # nothing has been written yet
        return todo
    types = dict(todo.dtypes)
    return todo.join(done.select(*[F.col(k).cast(types[k]).alias(k) for k in keys]), keys, "left_anti")


def resumed(spark: SparkSession, todo: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, keys: list[str], steps: int) -> int:
    """Computes what ``remaining`` names in ``steps`` parts, each written before the next; the number of parts that had anything to
    do. Parts are dealt by a hash of the keys, so they are the same at every run. A shard that ``compute`` gives no rows
    for has no folder and is computed anew."""
    did = 0
    for k in range(steps):
        part = remaining(todo, path, keys).filter(F.pmod(F.xxhash64(*keys), F.lit(steps)) == k)
        if not part.isEmpty():
            write_shards(compute(part), path, keys)
            did += 1
    return did
