"""Cutting the lineage of loops."""

from __future__ import annotations

import gc
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be sent to all executors.
FEW = 50_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir names a folder that all executors share. Only where it is unset, on one
    machine, a temporary folder is taken."""
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-checkpoint-"))
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the session's checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table of its own below the checkpoint folder, for loops of many rounds: a checkpoint
    keeps the size that its plan was thought to have, which grows with each join of each round;
    a table is read with the size that it has. That is the size of packed files, of which a few MB may
    hold millions of rows, so a table of more than FEW rows asks to be joined by sorting and never
    goes through the driver."""
    path, rows = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}", Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if rows.get["n"] > FEW else out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into the session's number of partitions. Spark puts the small ones of its own
    joins together, until a task sorts 64 MB of packed rows for each; it leaves these as they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that stored() has written and nothing reads any more."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f.rsplit("/", 1)[-1].startswith("table-"):
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files and checkpoints of tables that nothing refers to any more:
    its cleaner waits for the driver's collector, which in a loop of small tables seldom runs."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
