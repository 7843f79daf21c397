"""Where tables between jobs go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a temporary one serves in local mode (tests); on a cluster that is an error, as each executor
    would write to its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/marlstone-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    return f"{run_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the run folder, so that it is worked out once; it stays until clean()."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def given_back(spark: SparkSession, folder: str) -> None:
    """Deletes a folder under run_dir(), by whatever file system it is on; nothing may read it any more."""
    if not f"{folder}/".startswith(f"{run_dir(spark)}/"):
        raise ValueError(f"{folder} isn't of this application's run folder")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Gives back the run folder: call it when no result of this application is read any more."""
    given_back(spark, run_dir(spark))
