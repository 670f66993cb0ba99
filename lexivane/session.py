"""Session defaults and the shared folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "lexivane", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small tables here, but enough work a row to use all cores
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEXIVANE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may do without it: it has one machine, whose
    folder for temporary files is then set; on a cluster an unset folder is an error, since each executor would write to its own disk."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + os.path.join(tempfile.gettempdir(), "lexivane-shared")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


#: Folders that cut wrote and that aren't deleted yet, the oldest first.
_written: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of executors.

    What is written stays until the scratch it was written in ends, or until the process does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder for what is written otherwise; deleted as what cut writes is."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(paths: list[str]) -> None:
    from pyspark import SparkContext

    gateway = SparkContext._gateway
    if gateway is None:
        return
    hadoop = gateway.jvm.org.apache.hadoop
    for path in paths:
        p = hadoop.fs.Path(path)
        p.getFileSystem(hadoop.conf.Configuration()).delete(p, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what cut wrote within it: for results that are read, or written elsewhere, by then."""
    before = len(_written)
    try:
        yield
    finally:
        paths = _written[before:]
        del _written[before:]
        _delete(paths)


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # the JVM may be gone already
        _delete(_written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """scan (of files) in at least as many partitions as there are cores: one small file would else keep a single core busy.

    An input with fewer partitions than cores is small by its nature, so what is shuffled here doesn't grow with the data.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
