"""Prepared datasets and result documents as Parquet below one folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.sources.resources import last_entries

# Written by the committer as the last file of a table.
COMPLETE = "_SUCCESS"


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end; what a failed job left is no table."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMPLETE}")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if is_complete(spark, path) else None


def write_new(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a table that must not exist yet; remains of an unfinished write are replaced."""
    mode = "errorifexists" if is_complete(df.sparkSession, path) else "overwrite"
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


class DatasetStore:
    """Tables and JSON documents by kind and id."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, kind: str, key: str) -> str:
        return f"{self.folder}/{kind}/{key}"

    def save_dataset(self, dataset_id: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        write_new(df, self.path("datasets", dataset_id), partition_by)

    def dataset(self, dataset_id: str) -> DataFrame | None:
        """The stored dataset, or None if there is none."""
        return read_if_exists(self.spark, self.path("datasets", dataset_id))

    def save_document(self, kind: str, key: str, result: DataFrame, replace: bool = False) -> None:
        """Store a result as one JSON text per row; ``replace`` overwrites an earlier one."""
        value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in result.columns]), {"ignoreNullFields": "false"})
        document, path = result.select(value.alias("value")), self.path(kind, key)
        if replace:
            document.write.mode("overwrite").parquet(path)
        else:
            write_new(document, path)

    def document(self, kind: str, key: str, schema: str) -> DataFrame | None:
        """The rows of a stored result with the given DDL schema, or None."""
        stored = read_if_exists(self.spark, self.path(kind, key))
        if stored is None:
            return None
        return stored.select(F.from_json("value", schema).alias("d")).select("d.*")


class ResourceStore:
    """A table of resources that batches of PUT and DELETE change, rewriting only what they touch.

    Rows lie in buckets by the hash of their key. A batch writes the buckets of its keys anew, as a
    generation of its own, and then a list of every bucket's generation; readers go by the newest
    complete list. A batch that fails leaves the store as it was and may be applied again. Deleted
    keys stay as entries, so that a late PUT of an older version does not bring them back.

    Choose ``buckets`` so that one of them is a task's work; it is fixed once the store exists.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, version: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.key, self.version, self.buckets = key, version, buckets

    def _newest(self) -> int:
        """Number of the newest complete generation, 0 if there is none."""
        heads = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/heads")
        files = heads.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(heads):
            return 0
        numbers = sorted((int(f.getPath().getName()) for f in files.listStatus(heads)), reverse=True)
        return next((n for n in numbers if is_complete(self.spark, f"{self.folder}/heads/{n}")), 0)

    def _heads(self, generation: int) -> dict[int, int]:
        """Generation of every bucket: a row per bucket."""
        if not generation:
            return {}
        return dict(self.spark.read.parquet(f"{self.folder}/heads/{generation}").collect())

    def _rows(self, heads: dict[int, int]) -> DataFrame | None:
        if not heads:
            return None
        paths = [f"{self.folder}/rows/generation={g}/bucket={b}" for b, g in sorted(heads.items())]
        return self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*paths).drop("generation", "bucket")

    def entries(self) -> DataFrame | None:
        """The last entry of every key, deleted ones included; None before the first batch."""
        return self._rows(self._heads(self._newest()))

    def read(self) -> DataFrame | None:
        """The resources that are there."""
        entries = self.entries()
        return None if entries is None else entries.filter("method = 'PUT'").drop("method")

    def apply(self, batch: DataFrame) -> None:
        """Apply entries with ``method``, in the order of ``last_entries``; the batch comes after stored rows."""
        before = self._newest()
        heads = self._heads(before)
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in batch.filter(F.col(self.key).isNotNull()).select(bucket).distinct().collect()}
        if not touched:
            return
        entries = batch.withColumn("_batch", F.lit(1))
        stored = self._rows({b: g for b, g in heads.items() if b in touched})
        if stored is not None:
            entries = entries.unionByName(stored.withColumn("_batch", F.lit(0)))
        last = last_entries(entries, self.key, self.version, "_batch").withColumn("bucket", bucket)
        # Remains of a batch that failed under this number are replaced.
        rows = last.repartition("bucket").write.mode("overwrite").partitionBy("bucket")
        rows.parquet(f"{self.folder}/rows/generation={before + 1}")
        heads |= dict.fromkeys(touched, before + 1)
        listed = self.spark.createDataFrame(sorted(heads.items()), "bucket int, generation int")
        write_new(listed.coalesce(1), f"{self.folder}/heads/{before + 1}")


SITE_SCHEMA = "agent_id string, name string, endpoint string"


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """The site registry: a JSON file with an array of ``{agent_id, name, endpoint}``."""
    return spark.read.schema(SITE_SCHEMA).option("multiLine", True).json(path)
