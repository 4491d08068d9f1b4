"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset, as in local tests.
DEFAULT_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI: ``spark.checkpoint.dir``, or in local mode a default where that is unset.

    On a cluster there is no default: what one machine writes below its own folders, the others can't read.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or DEFAULT_SHARED).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def small_side(side: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``side`` of a join, to be broadcast if it has ``most`` rows or fewer; else left to a shuffle.

    For narrow stored tables: it is counted by a job of its own.
    """
    return F.broadcast(side) if side.count() <= most else side


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores: for narrow tables in few files whose rows grow large, before they do."""
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


#: Rows of a narrow table that a task groups or joins at once.
TASK_ROWS = 250_000


def parts_of(df: DataFrame, times: float = 1) -> int:
    """How many parts ``df``, or ``times`` as many rows, are to be dealt into so that a task's share doesn't grow with them; a shuffle's at least.

    For tables as they are stored, whose rows are counted without being read.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() * times / TASK_ROWS))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """From now on the session hands Python ``rows`` rows at most at once: for rows that hold whole pages. A smaller setting stays.

    Results are lazy, so this can't be undone before they are read.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later jobs read the files, so they neither repeat the work nor depend on any executor's
    local state. An empty input gives an empty table of the same schema.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
