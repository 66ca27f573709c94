"""Session helpers: worker import path and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The folders that stored() has written, by application.
_STORED: dict[str, list[str]] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Spark's own values of the size of batches for Python workers, and those set in their place: a batch
#: stands in the JVM, in the worker and in the worker's lists, in every task at a time.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": (64 << 20, 16 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, 4096)}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started, and bound the
    batches that they get where the session has Spark's own values for that."""
    for name, (usual, ours) in _BATCHES.items():
        if spark.conf.get(name, str(ours)).rstrip("bB") == str(usual):
            spark.conf.set(name, str(ours))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the session has it, else the checkpoint
    folder already set on the context; only without either, and only where all
    tasks run in the driver's process (tests on one machine), a temporary folder
    is made and set. On a cluster that would be another folder on each machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="keelstone-")
    sc.setCheckpointDir(base)
    return base


def _made(spark: SparkSession) -> list[str]:
    return _STORED.setdefault(spark.sparkContext.applicationId, [])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it again.

    Cuts the lineage: later plans read the files, and a lost executor costs no
    recomputation. The folder name is unique, so reruns never mix. The files stay,
    as results are read lazily; clean() deletes them once results have been used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    made = _made(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
        made[:] = [p for p in made if p.rsplit("/", 1)[-1] != folder.rsplit("/", 1)[-1]]


def clean(spark: SparkSession) -> int:
    """Delete all that stored() has written so far; how many tables that were."""
    made = _made(spark)
    n = len(made)
    while made:
        _delete(spark, made.pop())
    return n


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what build() gives, delete all that it stored on the way, and read the result again."""
    before = set(_made(spark))
    out = stored(build(), name)
    made = _made(spark)
    for path in [p for p in made[:-1] if p not in before]:
        made.remove(path)
        _delete(spark, path)
    return out
