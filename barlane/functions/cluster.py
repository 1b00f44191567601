"""What tasks need of the driver: this package's code, and the folder that all machines share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark application; their import path need not hold it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="barlane-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(archive := f"{folder}/barlane_shipped.zip", "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that the driver and all executors share.

    spark.checkpoint.dir names it. Where that is unset on one machine, as in tests, a temporary folder is made and set;
    on a cluster that is an error, since machines don't see each other's folders.
    """
    uri = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="barlane-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        uri = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", uri)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(uri)
    return uri.rstrip("/")


def filesystem(uri: str):
    """(file system, path) of a URI for Arrow: local, HDFS or an object store, by the scheme. Hadoop's names of S3 mean S3."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
