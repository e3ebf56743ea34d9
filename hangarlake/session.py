"""Session settings and the folder that cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What is sent to every executor at most: rows, and characters of strings.
SENT_ROWS, SENT_CHARS = 500_000, 1 << 26


def local_session(cores: int | str = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hangarlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where none is set (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="hangarlake-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder: it survives lost executors and has no lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sent(df: DataFrame, rows: int = SENT_ROWS, chars: int = SENT_CHARS) -> DataFrame:
    """``df`` marked for sending to every executor if it is measured to be within the bounds, else as it is: a join then exchanges both sides."""
    strings = [F.coalesce(F.length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, StringType)]
    size = sum(strings, F.lit(0).cast("long"))
    measured = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("chars")).first()
    return F.broadcast(df) if measured["n"] <= rows and measured["chars"] <= chars else df
