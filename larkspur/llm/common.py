"""What the training-data operators share: tables, the shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at once; Spark's own 64 MB would stand several times in a worker and once in the JVM.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers of at most BATCH_BYTES; a smaller setting stays."""
    if int(spark.conf.get(BATCH).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode a temporary one may stand in for it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="larkspur-"))
    return sc.getCheckpointDir()


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """The files under path go when the driver's JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that no later failure runs its lineage again.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # the codec of Parquet files by default takes memory outside the heap for every file, this one does not
    df.write.option("compression", "zstd").parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z alone become a-z; lower() would change other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, id_column: str, keep: bool = True, most: int = 1_000_000) -> DataFrame:
    """Rows of df whose key is (keep) or is not among ids. ids is broadcast only where its counted rows are at most `most`."""
    how = "left_semi" if keep else "left_anti"
    small = ids.limit(most + 1).count() <= most
    right = ids.select(F.col(id_column).alias("__id"))
    return df.join(F.broadcast(right) if small else right, F.col(key) == F.col("__id"), how)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b); component is the smallest node reachable.

    Every round takes the smallest label among neighbours and then follows the label's own label, so that a chain of
    length d ends after about log d rounds. Labels stay distributed, and every round is written to the shared folder.
    """
    both = settle(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "edges")
    labels = settle(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("component").alias("near"))
        best = both.join(seen, "other").groupBy("node").agg(F.min("near").alias("near"))
        low = labels.join(best, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        new = low.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("further", "to")).alias("component"))
        new = settle(new, "labels")
        labels = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            return labels
