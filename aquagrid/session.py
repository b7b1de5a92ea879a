"""Session helpers for jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession


def build_session(app_name="aquagrid", master=None, shuffle_partitions=None):
    """A session with adaptive execution on. Cluster settings win: a master, a partition
    count or a checkpoint folder is only set here where the caller asks for it."""
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", "12g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark):
    """Use the folder the cluster names in ``spark.checkpoint.dir``; a local folder of our
    own is taken only in a session that names none (tests, laptops)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="aquagrid-checkpoint-")
    if configured is not None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint: the plan restarts from files every executor can reach."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark, free=True):
    """What is planned and run inside removes its shuffle files when it is done."""
    before = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        if free:
            spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def stored(df, free=False):
    """The rows, written to the checkpoint folder and read again. For loops: a checkpoint keeps
    the size estimate of its plan, which multiplies in every join of every round, until planning
    takes longer than the job; files start it anew. And for rows that several parts of a plan must
    see alike: a sum or mean of doubles may end in another last bit each time it is computed.
    With ``free`` the shuffle files of the write are removed when it is done."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid4().hex}"
    with shuffles_freed(spark, free):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df, key):
    """The rows, written to the checkpoint folder in buckets of ``key`` and read again, so that a
    join on it reads them where they lie. ``df`` should come out of a shuffle by that key, else every
    task writes a file for each bucket; its shuffle files are removed."""
    spark = df.sparkSession
    name = f"bucketed_{uuid4().hex}"
    with shuffles_freed(spark):
        (df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
         .option("compression", "zstd")
         .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)
