"""Shared helpers: work tables, input columns, and the fold of a document."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is set, which only a local master can use.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_root(spark: SparkSession) -> str:
    """The folder of this application's work files, below the shared folder."""
    return f"{shared_root(spark)}/work/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path among this application's work files."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete this application's work files; DataFrames that operators have returned can't be used after."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Like :func:`written`, as files bucketed by ``column``: a join on it leaves these rows in place.

    The rows aren't shuffled to be written; each task writes to the buckets that its rows have. The
    name that the writer needs is dropped from the catalog at once, so only the files stay.
    """
    spark = df.sparkSession
    buckets = max(8, min(int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")), 2 * df.rdd.getNumPartitions()))
    table = f"crosspan_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", work_path(spark, name)).bucketBy(buckets, column).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, with null read as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fold(column: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
