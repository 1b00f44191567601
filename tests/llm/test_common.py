"""Paths of shards by the scheme of their URI."""

from pyarrow import fs

from barlane.llm import common


def test_schemes():
    local, path = common.filesystem("file:///tmp/a/b")
    assert isinstance(local, fs.LocalFileSystem) and path == "/tmp/a/b"
    # The region is given, so that no store is asked for it.
    for scheme in ("s3", "s3a", "s3n"):
        store, path = common.filesystem(f"{scheme}://bucket/a/b?region=eu-west-1")
        assert isinstance(store, fs.S3FileSystem) and path == "bucket/a/b"


def test_clear_deletes_what_operators_leave(spark):
    import os

    common.clear(spark)
    left = common.written(spark.range(3), "left")
    with common.workspace(spark, "work") as keep:
        common.written(spark.range(3), "inside")
        kept = keep(spark.range(4), "kept")
    assert left.count() == 3 and kept.count() == 4
    paths = list(common._made)
    assert common.clear(spark) >= 2 and common.clear(spark) == 0
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "did int, DID_ int, th_ int")
    assert common.fresh(df, "did", "th") == ["did__", "th"]
