"""Files behind tables: listing, statistics, signatures, deletion. Contents are never read."""

from __future__ import annotations

from collections.abc import Mapping as Dict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size and modified of all data files at or below ``path``.

    The file source that reads whole files as rows opens none when its content column is not asked for. Tasks are cut
    by file size as if contents were read; the session used here lets a task hold any size, so there are as many tasks
    as cores.
    """
    lister = spark.newSession()
    lister.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 60))
    files = lister.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, files and newest modification of a table kept in files."""
    return listing(spark, path).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"), F.count("*").alias("files"), F.max("modified").alias("last_modified")
    )


def file_signatures(spark: SparkSession, paths: Dict[str, str]) -> DataFrame:
    """(table, method, items, digest) of tables from path, size and modification time of their files, in one job."""
    digest = F.sum(F.xxhash64("path", "size", F.col("modified").cast("double")).cast("decimal(38,0)"))
    parts = [
        listing(spark, path).agg(F.count("*").alias("items"), F.coalesce(digest, F.lit(0)).cast("string").alias("digest"))
        .select(F.lit(name).alias("table"), F.lit("files").alias("method"), "items", "digest")
        for name, path in sorted(paths.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def _place(spark: SparkSession, path: str):
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        system, place = _place(spark, path)
        system.delete(place, True)
