"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE picks the reduce-side partition count, splits skewed join partitions and
# turns sort-merge joins into broadcast joins once the real size is known.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streams keep a state per review: on disk, with only the changes of a batch checkpointed
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "feedloom", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from `spark.checkpoint.dir`.

    A session in one process that has none gets a temporary folder of its own, as
    in tests. On a cluster the setting is required: a folder of one machine would
    be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="feedloom-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


# Bytes that a task of a written frame reads from files and from shuffles. Rows of few columns are
# 20 to 40 times as large in a sort or a hash map as in compressed files.
PIECES = {"spark.sql.files.maxPartitionBytes": 8 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20}
PARTITIONS = 1000       # of a shuffle, before AQE joins small ones


def size_in_bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside read at most `PIECES` per task, so their memory per task does not grow with the input.

    Smaller settings of the session stay. Where AQE does not join small partitions, their number stays too.
    """
    old = {k: spark.conf.get(k) for k in (*PIECES, "spark.sql.shuffle.partitions")}
    new = {k: f"{min(v, size_in_bytes(old[k]))}b" for k, v in PIECES.items()}
    if all(spark.conf.get(f"spark.sql.adaptive.{k}") == "true" for k in ("enabled", "coalescePartitions.enabled")):
        new["spark.sql.shuffle.partitions"] = str(max(PARTITIONS, int(old["spark.sql.shuffle.partitions"])))
    try:
        for key, value in new.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key in new:
            spark.conf.set(key, old[key])


def cut_lineage(df: DataFrame) -> DataFrame:
    """A frame that several jobs read, or that follows from a large shuffle, written once as Parquet below the shared folder.

    Readers of the result prune columns and push filters as with any table.
    """
    path = scratch_path(df.sparkSession, "frame")
    with small_tasks(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, below the shared folder."""
    return f"{shared_folder(spark)}/feedloom/{name}-{uuid.uuid4().hex}"
