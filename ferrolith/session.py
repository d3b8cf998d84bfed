"""Session settings that the operators assume."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used by local sessions that name no shared folder.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


def get_session(app: str = "ferrolith", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; sizes of partitions are left to the cluster's configuration."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, whichever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, system = hadoop_path(spark, path)
    return system.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at, system = hadoop_path(spark, path)
    return system.exists(at) and system.getFileStatus(at).isDirectory()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir. A cluster must name it; a local session gets one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINT_DIR)
        named = LOCAL_CHECKPOINT_DIR
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage and plan end there, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/ferrolith/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
