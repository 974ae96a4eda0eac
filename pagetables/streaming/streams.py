"""Streaming forms of batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetables.functions.urls import site_of
from pagetables.operators.merge import merge_by_key
from pagetables.operators.pages import page_links, page_meta, page_title
from pagetables.session import shared_folder


def scratch(spark: SparkSession) -> str:
    """Fresh folder for checkpoints and results, below the folder that the cluster shares."""
    return f"{shared_folder(spark)}/pagetables-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of a folder as a stream, whether it is one file or a directory of files."""
    path = f"{folder}/{name}.parquet"
    static = spark.read.parquet(path)
    reader = spark.readStream.schema(static.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    single = any(f.rstrip("/").endswith(f"/{name}.parquet") for f in static.inputFiles()[:1])
    if single:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its output as a table (parquet, then read back)."""
    spark = stream.sparkSession
    base = scratch(spark)

    def save(batch: DataFrame, batch_id: int) -> None:
        # the folder carries the batch id: a repeated batch replaces its own output
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(_with_batch(stream.schema)).parquet(f"{base}/out")


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def latest_batch(updates: DataFrame, key: str) -> DataFrame:
    """State of an update-mode stream: the row of the last batch per key."""
    values = [c for c in updates.columns if c not in (key, "batch_id")]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*values), "batch_id").alias("s"))
    return last.select(key, "s.*")


def stream_links(pages: DataFrame) -> DataFrame:
    """Links of arriving pages: the batch operator, unchanged."""
    return page_links(pages)


def stream_titles(pages: DataFrame) -> DataFrame:
    """Titles of arriving pages."""
    return page_title(pages)


def stream_meta(pages: DataFrame) -> DataFrame:
    """Named meta tags of arriving pages."""
    return page_meta(pages)


def stream_dedup_urls(links: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """First arrival of each (site, URL) within the watermark."""
    keyed = links.withColumn("site", site_of("href")).withWatermark(ts, delay)
    return keyed.dropDuplicatesWithinWatermark(["site", "href"])


class MergeSink:
    """Upsert by URL for a stream, as a table of partial merges.

    Every micro-batch is merged in itself and written below its batch id, so a repeated batch replaces its own files.
    Merging is associative over batches, so a read merges the partial rows. `compact` folds all batches so far into
    one and starts a new generation: later batches and reads use that one only, and the folders of earlier generations
    may be deleted. A generation is named by the first batch id that is not in its folded part, so a batch that is
    repeated after a compaction changes nothing.
    """

    def __init__(self, path: str, key: str, order: Sequence[str]) -> None:
        self.path, self.key, self.order, self.generation = path, key, list(order), 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id >= self.generation:
            self._write(merge_by_key(batch, self.key, self.order), batch_id)

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/generation={self.generation}/batch_id={batch_id}")

    def resume(self, spark: SparkSession) -> MergeSink:
        """Take up the latest generation of a table that an earlier run wrote."""
        self.generation = spark.read.parquet(self.path).agg(F.max(F.col("generation").cast("bigint"))).first()[0] or 0
        return self

    def _partial(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(f"{self.path}/generation={self.generation}")
        return rows.withColumn("batch_id", F.col("batch_id").cast("bigint"))

    def read(self, spark: SparkSession) -> DataFrame:
        return merge_by_key(self._partial(spark), self.key, ["batch_id", *self.order]).drop("batch_id")

    def compact(self, spark: SparkSession) -> None:
        rows = self._partial(spark)
        last = rows.agg(F.max("batch_id")).first()[0]
        merged = merge_by_key(rows, self.key, ["batch_id", *self.order]).drop("batch_id")
        if last is not None and last >= self.generation:
            self.generation = last + 1
            self._write(merged, -1)
