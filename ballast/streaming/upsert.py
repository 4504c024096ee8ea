"""A keyed table that micro-batches merge into, a version at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "bucket_"


class MergedTable:
    """Rows in buckets by a hash of `keys`; a version is one small file that names a folder for each bucket.

    A merge reads and rewrites only the buckets its batch touches, into a new folder, and then
    publishes the next version by renaming its file into place. So readers see whole versions, a
    writer that dies leaves folders nobody reads, and an epoch that is merged already does
    nothing when it is replayed. The folder has to be on a file system whose rename is atomic.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], buckets: int = 16):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, keys, buckets
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        place = self._paths.Path(f"{self.root}/{path}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def version(self) -> dict:
        """The newest version: its number, the epoch merged last, and the folder of each bucket."""
        files, place = self._at("versions")
        found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        numbers = [int(name.removesuffix(".json")) for name in found if name.endswith(".json")]
        if not numbers:
            return {"number": 0, "epoch": -1, "folders": {}}
        stream = files.open(self._at(f"versions/{max(numbers):012d}.json")[1])
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: dict) -> None:
        files, draft = self._at(f"versions/.{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(json.dumps(version).encode())
        stream.close()
        target = self._at(f"versions/{version['number']:012d}.json")[1]
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise RuntimeError(f"version {version['number']} of {self.root} was published by another writer")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest version, or the given buckets of it."""
        folders = self.version()["folders"]
        chosen = [f"{self.root}/{path}" for bucket, path in folders.items() if buckets is None or int(bucket) in buckets]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def merge(self, batch: DataFrame, epoch: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replace the touched buckets by `combine(stored, batch)`; False if the epoch is merged already."""
        before = self.version()
        if epoch <= before["epoch"]:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # at most one number a bucket comes to the driver
        touched = sorted(row[0] for row in batch.select(bucket.alias(BUCKET)).distinct().collect())
        folders = dict(before["folders"])
        if touched:
            data = f"data/{uuid.uuid4().hex}"
            merged = combine(self.read(touched), batch).select(*self.schema.names).withColumn(BUCKET, bucket)
            merged.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{data}")
            for number in touched:
                own = f"{data}/{BUCKET}={number}"
                files, place = self._at(own)
                if files.exists(place):
                    folders[str(number)] = own
                else:
                    folders.pop(str(number), None)
        self._publish({"number": before["number"] + 1, "epoch": epoch, "folders": folders})
        return True


def run_merged(
    stream: DataFrame, table: MergedTable, state: str, prepare: Callable[[DataFrame], DataFrame],
    combine: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Merge what is available of `stream` into the table; a second run continues from `state`."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, epoch: table.merge(prepare(batch), epoch, combine))
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return table.read()
