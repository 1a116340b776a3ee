"""What a session needs: the package on Python workers' paths, and a shared folder for tables between steps."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_folders: set[str] = set()
#: Tables of the blocks that will delete them.
_written: list[list[DataFrame]] = []


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once; Spark serves them to every executor.

    Nothing to do where PYTHONPATH, which workers inherit, already names the folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT.parent) in paths:
        return
    path = Path(tempfile.mkdtemp(prefix="maskframe-")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    sc.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a local session gets a temporary folder, deleted at exit; on a cluster that would be a folder of each
    machine's own, so it raises there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="maskframe-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/maskframe-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the application's folder in the shared one, which goes when the driver's process ends."""
    folder = _folder(spark)
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_forget, spark, folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, folder: str) -> None:
    if folder.startswith(("/", "file:")):
        shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    try:
        delete(spark, folder)
    except Exception:  # the session has gone already: its folder is the cluster's to clean
        pass


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application wrote between steps; results that still read from it are gone then."""
    delete(spark, _folder(spark))


@contextmanager
def temporary():
    """Tables written in this block are deleted at its end, but for those written with ``keep``."""
    mine: list[DataFrame] = []
    _written.append(mine)
    try:
        yield
    finally:
        _written.remove(mine)
        done(*mine)


def written(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _written and not keep:
        _written[-1].append(out)
    return out


def done(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._written_to)
