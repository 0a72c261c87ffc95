"""Lineage cuts and the folder they are kept in."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session names it. Only where it is unset and
    the session is local (tests, one machine) a temporary folder takes its
    place, which goes when the driver ends; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="loom-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


#: Lets a finished query drop its shuffle files; stages that need them again are run again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Most bytes that a task hands to Python at a time. Texts held by Spark's own bound, 64 MB, take several times that beyond the heap, for each task.
_BATCH, _DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python at a time, once, unless the session has a bound of its own. A single longer row goes alone."""
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and keeps it in the shared folder, where the loss of executors doesn't reach it.

    Shuffle files that led to it are dropped at once, as nothing reads them
    after that; the first cut turns this on for the session, once, unless
    ``spark.loom.keepShuffleFiles`` is set. What is kept goes with its DataFrame if the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    small_batches(spark)
    if spark.conf.get(_CLEANUP, None) != "true" and not spark.conf.get("spark.loom.keepShuffleFiles", ""):
        spark.conf.set(_CLEANUP, "true")
    return df.select("*").checkpoint(eager=True)


def rekeyed(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, aggregated by ``keys`` (whole numbers), for a join on them with a side that can be skewed.

    An aggregate's output is dealt by its keys already, so that the join would
    run in the aggregate's stage, where adaptive execution can't split the other
    side's partitions. Written anew the keys get an exchange of their own.
    """
    return df.withColumns({k: F.bitwise_not(F.bitwise_not(k)) for k in keys})
