"""Session, table and lineage helpers shared by every module."""

from __future__ import annotations

import gc
import tempfile
import time
import zipfile
from collections.abc import Callable
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def session(app: str = "spindrift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the UTC zone; conf entries override."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which executors share: the one that spark.checkpoint.dir names.

    Only where none is named and Spark runs in one process (local mode, as in tests) a temporary
    folder is made; on a cluster that would be another machine's disk, so it is an error there.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_unused(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of DataFrames that are no longer referred to, rather than at the driver's next collection."""
    gc.collect()
    for _ in range(2):  # the first frees what holds the rest
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)  # the cleaner works on a thread of its own


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spindrift-code-")) / "spindrift-code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(path))  # Spark's own file server hands it on
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow whose functions may come from modules of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def rewritten_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared checkpoint folder and read again, and the folder of its files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def rewritten(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again."""
    return rewritten_at(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that rewritten_at made, when nothing reads it any more."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
