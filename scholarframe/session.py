"""Session settings and durable intermediate results.

Intermediate results that cut a lineage go to the folder named by
``spark.checkpoint.dir``, which a cluster shares between its executors.  A
temporary folder is used only where that setting is absent and the master is
local, as in tests; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def session(app: str = "scholarframe", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate results, shared by all executors."""
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="scholarframe-"))
    return spark.sparkContext.getCheckpointDir()


#: Rows that a task gets where rows are dealt by a key for windows and aggregations over it.
ROWS_A_TASK = 1 << 18


def dealt(df: DataFrame, n_rows: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to so many tasks that one gets about :data:`ROWS_A_TASK` of ``n_rows``.

    Small tables, and those whose size is not known, are left to the session,
    which may put all of them into a few tasks.
    """
    if (n_rows or 0) <= ROWS_A_TASK:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, ceil(n_rows / ROWS_A_TASK)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as an eagerly written checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Columnar and compressed, so it suits results that are read several times
    with few columns; ``cut`` suits small, short-lived ones.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, folder: str, wanted: Callable[[str], bool]) -> int:
    """Deletes the children of a folder whose name is wanted, and gives how many went."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    children = [s.getPath() for s in system.listStatus(root)] if system.exists(root) else []
    return sum(bool(system.delete(p, True)) for p in children if wanted(p.getName()))


def clear_stored(spark: SparkSession) -> int:
    """Deletes what :func:`stored` wrote in this process and gives how many folders went.

    Call it when no result that was built on them is read any more.
    """
    conf, gone = spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone
