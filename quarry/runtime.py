"""Session helpers: the shared folder, and tables that cut lineage.

A long plan is cut by writing a Parquet table to the folder that the cluster
names in ``spark.checkpoint.dir``.  Such a table outlives the executor that
wrote it, so nothing is computed twice when executors are lost.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` where it is
    set, else (local mode only, as in tests) one temporary folder a process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _fallback["dir"], ignore_errors=True)
    return "file://" + _fallback["dir"]


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, whatever
    their working folder. A cluster without a shared folder needs --py-files."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has written in this process, once
    no frame that reads them is needed any more."""
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = path_of(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or it with a number, such that no column of ``taken`` is called so in any case."""
    low, k = {c.lower() for c in taken}, 0
    found = name
    while found.lower() in low:
        found, k = f"{name}_{k}", k + 1
    return found


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
