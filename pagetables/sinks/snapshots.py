"""A bundle of tables that readers see as one: written apart, then switched to by one manifest row.

    {path}/runs/{run_id}/{table}/...    the tables of a run
    {path}/manifests/*.parquet          one row for each committed run

A run writes its tables where no reader looks. When all of them are complete it appends one row to the manifests, a
single file that appears by a rename. A run that dies before leaves the earlier version as it was; one that is started
again under the same id writes only the tables that are missing, and changes nothing when it was committed already.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagetables.sinks.sheets import write_bundle

MANIFEST = "version bigint, run_id string, fmt string, tables array<struct<name:string,folder:string,schema:string>>"


def bundle_versions(spark: SparkSession, path: str) -> DataFrame:
    """version, run_id, fmt and tables of the committed runs. A path that holds none gives no rows."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def commit_bundle(tables: Mapping[str, DataFrame], path: str, run_id: str, fmt: str = "parquet", **options) -> int:
    """Write the tables as run `run_id` and make them the current version, whose number is returned.

    Runs that commit at the same time may get one number; readers then agree on the greater run id. `options` go to
    `write_bundle`. A failed run may be repeated with the same id.
    """
    if not run_id or "/" in run_id:
        raise ValueError("a run id is a name of a folder")
    spark = next(iter(tables.values())).sparkSession
    done = bundle_versions(spark, path).filter(F.col("run_id") == run_id).select("version").first()
    if done:
        return done["version"]
    entries = []
    for name, df in tables.items():
        folder = f"runs/{run_id}/{name.lower().replace(' ', '_')}"
        if not _complete(spark, f"{path}/{folder}"):
            write_bundle({name: df}, f"{path}/runs/{run_id}", fmt=fmt, **options)
        entries.append((name, folder, df.schema.json()))
    version = (bundle_versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    row = spark.createDataFrame([(version, run_id, fmt, entries)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifests")
    return version


def read_bundle(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version by name, of the latest one if none is given; empty tables keep their columns."""
    rows = bundle_versions(spark, path)
    rows = rows if version is None else rows.filter(F.col("version") == version)
    found = rows.orderBy(F.desc("version"), F.desc("run_id")).first()
    if found is None:
        raise ValueError(f"no version {'' if version is None else version} in {path}")
    out = {}
    for name, folder, schema in found["tables"]:
        kind = StructType.fromJson(json.loads(schema))
        if found["fmt"] == "csv":  # nested columns are JSON there
            reader = spark.read.option("header", True).format("csv")
            out[name] = reader.load(f"{path}/{folder}")
        else:
            out[name] = spark.read.schema(kind).format(found["fmt"]).load(f"{path}/{folder}")
    return out


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the tables of runs that were committed before the last `keep` versions; their run ids are returned.

    Runs that are not committed are left alone, they may be at work. Manifest rows stay, so a dropped run is not
    written again by a late retry.
    """
    rows = bundle_versions(spark, path).select("version", "run_id").orderBy(F.desc("version"), F.desc("run_id")).collect()
    dropped = []
    for row in rows[max(1, keep):]:
        folder = _folder(spark, f"{path}/runs/{row['run_id']}")
        if folder[0].exists(folder[1]):
            folder[0].delete(folder[1], True)
            dropped.append(row["run_id"])
    return dropped


def _complete(spark: SparkSession, folder: str) -> bool:
    files, path = _folder(spark, f"{folder}/_SUCCESS")
    return files.exists(path)


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop
