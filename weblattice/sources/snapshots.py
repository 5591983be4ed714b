"""Tables as immutable snapshots: a change writes a new version and then moves a pointer, so that readers and lost executors never see half of one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weblattice.schema import TABLES
from weblattice.session import cut


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in the place of those with the same key; new must have the same columns and no key twice."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those rows of new whose key it doesn't have; of equal keys in new one row is taken."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def latest(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The last row of each key by an order, which should leave no ties; combined before the shuffle, so that a hot key is no burden."""
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*by)).alias("__row"))
    return last.select("__row.*")


def numbered(df: DataFrame, name: str, by: list) -> DataFrame:
    """df with its rows numbered from 0 in an order that leaves no ties, without sorting them in one task.

    Rows are sorted in ranges, which are kept in the shared folder so that they are the same when counted and when read; a row per range
    gives the ranges' offsets.
    """
    parts = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", (before - F.col("__first")).alias("__offset"))
    return parts.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__m") + F.col("__offset")).drop("__p", "__m", "__offset")


def allocate(old: DataFrame, new: DataFrame, key: str, by: list[str], held: str | None = None) -> DataFrame:
    """new with ids in the column key, after the largest of old (there in the column held, if it has another name), in a stable order."""
    top = old.agg(F.coalesce(F.max(held or key), F.lit(0))).scalar()
    return numbered(new, key, by).withColumn(key, F.col(key) + top + 1)


def blobs(html: DataFrame) -> DataFrame:
    """(hash, html): content by its SHA-256, each once."""
    return html.where("html IS NOT NULL").select(F.unhex(F.sha2("html", 256)).alias("hash"), F.encode("html", "UTF-8").alias("html")).dropDuplicates(["hash"])


class Snapshots:
    """Versions of named tables in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str):
        return self._path(f"{self.folder}/{name}/current.json")

    def version(self, name: str) -> str | None:
        p = self._pointer(name)
        if not self._fs.exists(p):
            return None
        rows = self.spark.read.text(p.toString(), wholetext=True).collect()
        return json.loads(rows[0].value)["version"]

    def read(self, name: str) -> DataFrame:
        """The current version; a known table that was never written is empty."""
        v = self.version(name)
        if v is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.parquet(f"{self.folder}/{name}/{v}")

    def write(self, name: str, df: DataFrame, **options: str) -> str:
        """Writes a version and points to it; the last step is the renaming of a small file."""
        v = uuid.uuid4().hex
        df.write.options(**options).parquet(f"{self.folder}/{name}/{v}")
        p, tmp = self._pointer(name), self._path(f"{self.folder}/{name}/.{v}.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps({"version": v}).encode()))
        out.close()
        self._fs.delete(p, False)
        self._fs.rename(tmp, p)
        return v

    def write_blobs(self, html: DataFrame) -> str:
        return self.write("blobs", insert_ignore(self.read("blobs"), blobs(html), ["hash"]), compression="zstd")

    def bootstrap(self) -> list[str]:
        """Writes each known table that isn't there yet, in order; the names of those. Doing it again changes nothing."""
        made = []
        for name, schema in TABLES.items():
            if self.version(name) is None:
                self.write(name, self.spark.createDataFrame([], schema))
                made.append(name)
        return made
