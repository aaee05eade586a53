"""Reading and writing of tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..functions.core import col


_VERSION = "version-"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares between machines, named by ``spark.checkpoint.dir``.

    Where that is unset a session on this machine alone gets a folder of its own, removed
    when the process ends. On a cluster the folder has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = os.path.join(tempfile.gettempdir(), f"loanloom-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def register_views(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """Make the tables of a folder known to SQL text under their names; returns the names.

    Without ``names`` every ``<name>.parquet`` of the folder is registered.
    """
    if names is None:
        files, place = _files(spark, folder)
        listed = files.listStatus(place)
        names = sorted(f.getPath().getName().removesuffix(".parquet") for f in listed if f.getPath().getName().endswith(".parquet"))
    for name in names:
        scan_table(spark, name, folder).createOrReplaceTempView(name)
    return names


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN becomes a missing value."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.nanvl(col(c), F.lit(None)).alias(c) if c in floating else col(c) for c in df.columns])


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, drop: list[str] = ()) -> DataFrame:
    """CSV with a header: lower-case names, given columns dropped, NaN as missing.

    Without a schema the types are inferred, which reads the file once more.
    """
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    return nan_to_null(df.drop(*[c.lower() for c in drop]))


def scan_table(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A whole table, from a Parquet folder or the catalog."""
    return spark.read.parquet(f"{folder}/{name}.parquet") if folder else spark.table(name)


def scan_database(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table of a live database over JDBC; ``partition`` is (column, low, high, parts)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def sink_feature_file(df: DataFrame, path: str, key: str, form: str = "parquet") -> str:
    """Write a feature set, key column first."""
    ordered = df.select(key, *[col(c) for c in df.columns if c != key])
    writer = ordered.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)
    return path


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else ""


def sink_table_replace(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a catalog table and return it.

    The rows are written to a new folder below ``path`` (the table's folder in the
    warehouse without one) and the table is pointed to it only once that has ended well: a
    write that fails leaves the table as it was, and a table can be replaced by rows read
    from itself. With the columns it had before, the table changes in one step; other
    columns need it to be dropped and made again. The folder of the last version is then
    removed, so frames that still read it must not be used any more.
    """
    spark = df.sparkSession
    root = path or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), name)
    staged = os.path.join(root, f"{_VERSION}{uuid.uuid4().hex}")
    try:
        df.write.parquet(staged)
    except Exception:
        files, place = _files(spark, staged)
        files.delete(place, True)
        raise
    last = None
    if spark.catalog.tableExists(name):
        last = _location(spark, name)
        if spark.table(name).dtypes == df.dtypes:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{staged}'")
        else:
            spark.sql(f"DROP TABLE {name}")
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, staged, "parquet")
    spark.catalog.refreshTable(name)
    if last and os.path.basename(last).startswith(_VERSION):
        files, place = _files(spark, last)
        files.delete(place, True)
    return spark.table(name)


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """Write a table bucketed and sorted by a key, a file per bucket, and read it back.

    Tables of as many buckets join on the key without an exchange. It is an external table
    of the session's catalog in the shared folder.
    """
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, col(key)).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def materialized(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table that several later jobs read, and read it back.

    It lies in the shared folder, so losing an executor loses nothing, and the
    later jobs still read only the columns they need.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
