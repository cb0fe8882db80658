"""Session helpers: a default local session and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "cutlens", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks. On a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; on a cluster a
    missing setting is an error, because a machine-local folder would not survive the loss of an
    executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif re.fullmatch(r"local(\[.*\])?", context.master):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="cutlens-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder: computed once, read by all that follows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def landed(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: computed once, and each reader takes only the columns it asks for.
    For tables with many columns and several readers; the states of rounds are cut by ``cut_lineage``."""
    folder = f"{shared_folder(df.sparkSession)}/landed-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
