"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, removed when the application ends.

    In local mode, as in tests, a temporary folder serves where the setting is missing; on a cluster that is an error,
    since executors would not see one another's files.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="graphloom-")
        _folders[app] = f"{base.rstrip('/')}/graphloom-{app}"
        path = context._jvm.org.apache.hadoop.fs.Path(_folders[app])
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _folders[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: short lineage, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which is also the number of buckets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str, move: bool = True, by: str | None = None) -> DataFrame:
    """``cut`` into buckets of ``key``: joins and sums by it shuffle the other side alone, however often a loop reads the table.

    ``move=False`` if ``df`` is partitioned by ``key`` into ``parts`` already. With ``by`` each of its values has files of its own, and a loop that
    asks for one reads no other.
    """
    spark = df.sparkSession
    n, name = parts(spark), f"graphloom_{uuid.uuid4().hex}"
    rows = df.repartition(n, key) if move else df
    out = rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, key)
    (out if by is None else out.partitionBy(by)).saveAsTable(name)
    return spark.table(name)


SIZES = "spark.sql.sources.fileCompressionFactor"


def plain_sizes(spark: SparkSession) -> None:
    """Tables count as eight times their compressed files, unless the session has a factor of its own: zstd files of short strings are some
    eight times smaller than their rows, and at the size of the files tables of a million rows are sent through the driver."""
    if float(spark.conf.get(SIZES)) == 1.0:
        spark.conf.set(SIZES, "8.0")


def cut_counting(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many rows were written (for which ``what`` holds), counted while they are written."""
    seen = Observation()
    count = F.count(F.lit(1)) if what is None else F.count_if(what)
    out = cut(df.observe(seen, count.alias("n")))
    found = seen.get.get("n")
    return out, int(found) if found is not None else (out.count() if what is None else out.where(what).count())
