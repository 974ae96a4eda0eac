"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 8 << 20
#: Bytes of rows that a function gets at once; arrays made of them are some twenty times as large.
PART_BYTES = 1 << 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query by name, with its SQL twin where SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temp folder only for a local session that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="pagetables-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The same rows read from a table in the shared folder: lineage ends there, lost executors cost no recomputation.

    With `by`, the last column, there is one folder for each of its values.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """A table that grows with the input, as a side of a merge join: it is never gathered on the driver to be broadcast.

    Sizes are guessed from packed files and the types of columns, and an explode counts as one row, so a table of
    hundreds of MB can pass for one below the limit of broadcasts.
    """
    return df.hint("merge")


def give_back() -> None:
    """Return freed memory of this Python worker to the machine: it lives on, and the next stage may hold other things."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], Iterable[dict[str, list]]], schema: str, size: int = PART_BYTES,
) -> DataFrame:
    """Run `fn` over column lists of at most about `size` bytes each; it yields column lists of `schema`."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    out = pa.schema([(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size):
                for columns in fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)
        give_back()

    return df.mapInArrow(run, schema)


def judged(df: DataFrame, fn: Callable[[list], dict[str, list]], schema: str) -> DataFrame:
    """`df` (text and others) without its text and with the columns of `schema` that `fn` gives for a list of texts.

    The other columns pass as Arrow arrays, whatever their type.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    added = spark.createDataFrame([], schema).schema
    kinds = [(f.name, _arrow(f.dataType)) for f in added]
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, PART_BYTES):
                got = fn([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column(c) for c in kept] + [pa.array(got[name], kind) for name, kind in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(name for name, _ in kinds)])
        give_back()

    return df.mapInArrow(run, T.StructType([*df.select(*kept).schema, *added]))


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch in halves until a part has at most `size` bytes or one row."""
    if batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), size)
        yield from slices(batch.slice(half), size)
    elif batch.num_rows:
        yield batch


def in_blocks(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, size: int,
) -> DataFrame:
    """Run `fn` over the rows of a partition, joined to Arrow batches of about `size` bytes; a larger row comes alone."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in slices(batch, size):
                if held and sum(b.nbytes for b in held) + part.nbytes > size:
                    yield from fn(_joined(held))
                    held = []
                held.append(part)
        if held:
            yield from fn(_joined(held))
        held.clear()
        give_back()

    return df.mapInArrow(run, schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) for c in whole.columns], schema=whole.schema)


def out_schema(spark: SparkSession, schema: str | T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], schema).schema])


def forget(df: DataFrame) -> None:
    """Delete a table that `written` made and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in name:
            path = jvm.org.apache.hadoop.fs.Path(name[:name.index("/table-")] + "/" + name[name.index("/table-") + 1:].split("/")[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def grouped(df: DataFrame, keys: list[str], fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Run `fn` once for the whole rows of each key; callers bound the size of a group."""
    out = pa.schema([(f.name, _arrow(f.dataType)) for f in df.sparkSession.createDataFrame([], schema).schema])

    def run(rows: pa.Table) -> pa.Table:
        columns = fn({name: rows.column(name).to_pylist() for name in rows.schema.names})
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.groupBy(*keys).applyInArrow(run, schema)


def block_pairs(df: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Cut each group into blocks of about `block` rows and send every row to the pairs of blocks that hold its own.

    Adds `block_a` <= `block_b` and `own`. A group of one block is sent once; a larger one is spread over many
    bounded tasks, in which each pair of its rows meets exactly once.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    cut = df.join(merged(sizes), keys).withColumn("blocks", F.ceil(F.col("group_rows") / block).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    return (
        cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("block_a", F.least("own", "other"))
        .withColumn("block_b", F.greatest("own", "other"))
        .drop("group_rows", "blocks", "other")
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of `edges` (a, b: long): root is the smallest node of its connected component.

    Large-star and small-star rounds: each moves edges to smaller neighbours only, so the number of edges does not
    grow and no node's neighbours are gathered in one task. Every round is written to the shared folder.
    """
    known = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        sides = known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.join(merged(low), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(merged(low), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        known = written(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == seen:
            break
        seen = now
    roots = known.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(known.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
