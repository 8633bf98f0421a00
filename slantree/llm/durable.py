"""Tables written between steps, so that a lost executor does not lose them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch: texts are long, and a batch stands in memory on both sides of the pipe.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, `spark.checkpoint.dir`; on one machine only, a temporary folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def short_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches are short; a smaller setting of the user's stays."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_SETTING)) > BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: later steps neither recompute nor lose it.

    Results are lazy and read these tables later, so they stay; all of an
    application's tables stand under `slantree-<application id>`, to be deleted
    as a whole when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/slantree-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
