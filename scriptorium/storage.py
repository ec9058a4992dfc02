"""Tables written once to the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Sees to it that ``DataFrame.checkpoint`` has a folder that all executors share.

    The cluster's ``spark.checkpoint.dir`` is used where it is set. Where it is
    not, a temporary folder serves a session in one process (as in tests); on a
    cluster that is an error, since executors don't share such a folder.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    context.setCheckpointDir(own or tempfile.mkdtemp(prefix="scriptorium-"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed and stored by ``checkpoint()``, its lineage cut.

    The shuffle files that only its computation read are given up. Checkpoint
    files are Spark's to remove (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    ready(df.sparkSession)
    out = df.checkpoint(eager=True)
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing will read any more.

    Only for tables of :func:`saved` whose every reader has itself been saved.
    """
    for df in tables:
        context = df.sparkSession.sparkContext
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
