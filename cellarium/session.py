"""The session, and the folder where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "cellarium", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    ship(spark.sparkContext)
    return spark


def ship(sc: SparkContext) -> None:
    """Give executors the package, wherever they were started; once for an application."""
    if getattr(sc, "_cellarium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    package = os.path.join(tempfile.mkdtemp(prefix="package-"), "cellarium.zip")  # the driver serves it from here
    with zipfile.ZipFile(package, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    sc.addPyFile(package)
    sc._cellarium_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode, as in tests) a temporary one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if at is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


#: Rows up to which a side that has been cut is broadcast.
FEW = 50_000


@contextmanager
def measured(spark: SparkSession) -> Iterator[None]:
    """Here joins broadcast what was measured to be small when it was shuffled, and what has a hint, but nothing for its estimated
    size: estimates leave out how many rows exploded arrays make, so they take the cells of a large workbook for a small table."""
    guessed, found = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in (guessed, found)}
    spark.conf.set(found, before[found] or spark.conf.get(guessed))
    spark.conf.set(guessed, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Queries that are made here remove their shuffle files when they end, which otherwise waits for the driver to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there: later plans start at these files."""
    shared_dir(df.sparkSession)
    with measured(df.sparkSession), _swept(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed table in the same folder, for what is wide or is read with few of its columns."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    with measured(spark), _swept(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """A frame that has been cut, with a broadcast hint if it has FEW rows at most, so that what it meets needn't be shuffled."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def collected(spark: SparkSession) -> None:
    """Lets the JVM collect what nobody holds, on which Spark removes its files (with spark.cleaner.referenceTracking.cleanCheckpoints)."""
    spark.sparkContext._jvm.System.gc()
