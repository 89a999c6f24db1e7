"""Session settings and reliable checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Keep "first n rows per key" trimmed on the map side for every n used in plans.leaders.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(1 << 20),
    # Whole texts go to Python in these batches, so that a worker holds a few thousand of them at most.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators are tuned for; results do not depend on them, except the time zone."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, which all executors share.

    It is the one in `spark.checkpoint.dir`. Where that is unset, it is a folder of the warehouse; on a cluster whose
    warehouse is a folder of some machine, that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if not folder:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not shared and is_local_folder(warehouse) and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or f"{warehouse}/_checkpoints")
        folder = sc.getCheckpointDir()
    return folder


def is_local_folder(path: str) -> bool:
    """Whether a folder is one of a machine's own file system."""
    return path.startswith("file:") or "://" not in path


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and return a frame that reads it back.

    Cuts lineage and survives the loss of executors. Being Parquet, later steps read only the columns they use, and
    the planner knows the real size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Like `checkpointed`, but stored in buckets of `keys`, so that joins and groupings on them need no exchange.

    The session's catalog knows the table only while it is written and read in; the files stay in the folder.
    """
    spark = df.sparkSession
    name = f"_bucketed_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
    rows.option("path", f"{checkpoint_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return table
