"""Steps of iterative work, written to the shared folder so that lineage ends and a lost executor costs nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the session's checkpoint folder, else one beside the tables."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    return base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/larder-steps"


def step(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back. Its files stay until forget()."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.larder_path = path
    return out


def forget(*steps: DataFrame) -> None:
    """Deletes the files of steps that nothing will read again."""
    for df in steps:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.larder_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
