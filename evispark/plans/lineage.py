"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, that named by ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors are threads of this process
    gets a private folder; a session on a cluster fails, as a folder of one
    machine would be missing on the others.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evispark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder; for small tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as compressed Parquet and read again.

    For tables that several branches of a plan read: they are computed once,
    and a lost executor costs no more than reading files again.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
