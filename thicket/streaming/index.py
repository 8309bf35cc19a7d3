"""Index maintenance: description versions to index, extended types as of a time, and a token index kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from thicket.functions.text import token_table


def changed_versions(description: DataFrame) -> DataFrame:
    """Versions whose text or type differs from the version before."""
    order = Window.partitionBy("nid").orderBy("time", "state")
    now, before = F.struct("text", "dtype"), F.lag(F.struct("text", "dtype")).over(order)
    return description.withColumn("before", before).where(F.col("before").isNull() | (now != F.col("before"))).drop("before")


def as_of_texts(description: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each annotation (nid, ext_type, time) with the text of the description at its time, or its earliest text if it is older than
    all; repeats of the same text and type in a row are left out."""
    texts = description.select("nid", "time", "text", F.lit(None).cast("string").alias("ext_type"), F.lit(0).alias("kind"))
    both = texts.unionByName(annotations.select("nid", "time", F.lit(None).cast("string").alias("text"), "ext_type", F.lit(1).alias("kind")))
    up = Window.partitionBy("nid").orderBy("time", "kind", "text", "ext_type")
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    text = F.coalesce(F.last("text", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.first("text", ignorenulls=True).over(whole))
    met = both.withColumn("as_of", text).where("kind = 1 AND as_of IS NOT NULL").select("nid", "time", "ext_type", F.col("as_of").alias("text"))
    order = Window.partitionBy("nid", "ext_type").orderBy("time")
    return met.withColumn("before", F.lag("text").over(order)).where("before IS NULL OR before != text").drop("before")


SCHEMA = "nid long, term string, pos int, len int, version long"


class TokenIndex:
    """A token table on disk, grown by appending. Each batch is a generation; of what was indexed twice the reader sees one copy.

    Files hold terms in order, so a search for a term reads the row groups that can have it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.enabled = spark, path.rstrip("/"), True

    def _hadoop(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def add(self, rows: DataFrame, generation: int) -> None:
        """Index rows (nid, text). The same generation again, after a failure, replaces what it wrote."""
        if self.enabled:
            tokens = token_table(rows)
            tokens.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/generation={generation}")

    def tokens(self) -> DataFrame:
        fs, path = self._hadoop()
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(f"{SCHEMA}, generation long").parquet(self.path).drop("generation").distinct()

    def generation(self) -> int:
        """The last generation that can be searched; -1 if there is none."""
        fs, path = self._hadoop()
        if not fs.exists(path):
            return -1
        done = [s.getPath() for s in fs.listStatus(path)]
        jvm = self.spark._jvm
        return max((int(p.getName().split("=")[1]) for p in done if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=-1)

    def clear(self) -> None:
        fs, path = self._hadoop()
        fs.delete(path, True)

    def compact(self) -> None:
        """All generations as one, without repeats."""
        last, rows = self.generation(), self.tokens()
        if last < 0:
            return
        fs, path = self._hadoop()
        side = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}.compact")
        rows.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}.compact/generation={last}")
        fs.delete(path, True)
        fs.rename(side, path)

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = True, interval: str = "60 seconds"):
        """Index a stream of rows (nid, text) as they come; the batch's number is its generation. Returns the running query:
        ``processAllAvailable`` or ``awaitTermination`` waits until what came before can be searched."""
        writer = stream.writeStream.foreachBatch(lambda rows, n: self.add(rows, n)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
