"""Session settings shared by the command line, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/ruletide-checkpoints"


def local_session(cores: int | str = "*", app: str = "ruletide", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that every query here expects (UTC, adaptive execution)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session: they need not be started where it lies."""
    context = spark.sparkContext
    if getattr(context, "_ruletide_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="ruletide-"))  # the driver's own copy; Spark serves it to the executors
    with zipfile.ZipFile(folder / "ruletide.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(folder / "ruletide.zip"))
    context._ruletide_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make a session ready: its checkpoint folder is the one it names in spark.checkpoint.dir, and its workers know this package.

    Only a local session that names none (tests, notebooks) gets a folder in /tmp; on a cluster it would be lost with its
    executor, so there it is an error.
    """
    ship(spark)
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)


#: Bytes of Parquet for each partition that a shuffle begins with, and of shuffled data for each task that reads it.
INPUT_A_PARTITION, SHUFFLED_A_TASK = 4 << 20, 16 << 20
_INITIAL, _ADVISED, _SHUFFLE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"


def fit(spark: SparkSession, paths: list[str]) -> None:
    """Let the number of a shuffle's tasks follow the size of the tables read, so that a task's memory does not grow with them.

    Adaptive execution joins small partitions again. Without paths the session gets its own settings back.
    """
    context = spark.sparkContext
    if not hasattr(context, "_ruletide_own"):
        context._ruletide_own = {k: spark.conf.get(k, None) for k in (_INITIAL, _ADVISED)}
    for k, v in context._ruletide_own.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not paths:
        return
    size = sum(int(spark.read.parquet(p)._jdf.queryExecution().analyzed().stats().sizeInBytes()) for p in paths)
    least = max(int(spark.conf.get(_SHUFFLE)), int(context._ruletide_own[_INITIAL] or 0))
    if -(-size // INPUT_A_PARTITION) > least:
        spark.conf.set(_INITIAL, str(-(-size // INPUT_A_PARTITION)))
        if context._ruletide_own[_ADVISED] is None:
            spark.conf.set(_ADVISED, str(SHUFFLED_A_TASK))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over as many tasks as a shuffle begins with; adaptive execution does not join them again."""
    conf = df.sparkSession.conf
    return df.repartition(int(conf.get(_INITIAL, None) or conf.get(_SHUFFLE)), *by)


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """df kept in memory or on the executors' disks, as a query reads it several times; `release` lets go of all that is kept."""
    _kept.append(df.persist())
    return df


def release() -> None:
    """Let go of what earlier queries have kept; those still unread compute it again."""
    while _kept:
        _kept.pop().unpersist()


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see, for tables that a query writes and reads again."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or LOCAL_CHECKPOINTS
