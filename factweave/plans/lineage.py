"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_PATH = "_factweave_path"


def shared_root(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, else the one set on the context.

    A session with a local master has only this machine and may do without; it then gets a
    temporary folder. On a cluster that would be a folder of one machine, so it raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = sc._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factweave-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, below the shared checkpoint folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint of ``df``; survives the loss of any executor."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark, "lineage"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    setattr(back, _PATH, path)
    return back


def measured(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, dict]:
    """``stored``, with aggregates over the rows taken while they are written: no second job."""
    seen = Observation()
    back = stored(df.observe(seen, *[c.alias(k) for k, c in values.items()]), name)
    return back, seen.get


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``tables``, which nothing may read from then on."""
    for df in tables:
        path = getattr(df, _PATH, None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
