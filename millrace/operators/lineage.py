"""Cutting a plan's lineage, and following pointers between rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and go on from there.

    The folder is the session's spark.checkpoint.dir, or what setCheckpointDir was given. Without one a temporary folder
    is made where driver and executor are one process (a local master, as in tests); on a cluster this raises, since a
    folder of one machine would lose rows with it.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint()


def followed(pointers: DataFrame) -> DataFrame:
    """a, root: where the chains of pointers (a, b; one for each a, no circles) end. Each round doubles the steps taken."""
    now = cut(pointers.select("a", F.col("b").alias("root")))
    while True:
        ahead = now.select(F.col("a").alias("at"), F.col("root").alias("next"))
        joined = cut(now.join(ahead, F.col("root") == F.col("at"), "left").select("a", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = joined.select("a", "root")
        if not joined.filter("moved").take(1):
            return now
