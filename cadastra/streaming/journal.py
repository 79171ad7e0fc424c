"""Change journals as streams of files."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder` as a stream: new files of it are new rows. A table of one file is a stream of one."""
    path = f"{folder}/{name}.parquet"
    schema: StructType = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def fold(changes: DataFrame, scope: list[str], fields: list[str]) -> DataFrame:
    """Per entity the latest making and the latest removal: `scope`, entity_type, entity_id, made, removed.

    made is struct<seq, `fields`>. Maxima of maxima are maxima, so folds of parts can be folded again.
    """
    of = ["entity_type", *scope]
    made = changes.where("operation <> 'delete'").select(*of, "entity_id", F.struct("seq", *fields).alias("made"), F.lit(None).cast("bigint").alias("removed"))
    gone = changes.where("operation <> 'upsert'").select(*of, F.when(F.col("operation") == "delete", F.col("entity_id")).otherwise(F.col("old_entity_id")).alias("entity_id"), F.lit(None).cast(made.schema["made"].dataType).alias("made"), F.col("seq").alias("removed"))
    return merged(made.unionByName(gone), scope)


def merged(states: DataFrame, scope: list[str]) -> DataFrame:
    keys = [*scope, "entity_type", "entity_id"]
    return states.groupBy(*keys).agg(F.max("made").alias("made"), F.max("removed").alias("removed"))


def living(state: DataFrame) -> DataFrame:
    """Entities whose latest making is not followed by a removal; a removal with the same seq came before it."""
    return state.where("made is not null and (removed is null or removed <= made.seq)")


class JournalFold:
    """State of a change journal, kept up by micro-batches.

    The state is a binary indexed tree of folds over the batches: the folder of batch i - 1 (i from 1) holds the fold of the last
    i & -i batches, so of n batches a batch reads and rewrites no more than log n folders, on average two of its own size,
    and the state is the fold of at most log n folders. A batch that is run again overwrites its own folder from the same others, so
    its effect counts once. Folders that a later one covers are removed once the batch after it has begun.
    """

    def __init__(self, root: str, scope: list[str], fields: list[str]) -> None:
        self.root, self.scope, self.fields = root.rstrip("/"), scope, fields

    def _folder(self, batch: int) -> str:
        return f"{self.root}/state/batch={batch}"

    @staticmethod
    def covered(batch: int) -> list[int]:
        """The earlier batches whose folders the folder of this batch takes in."""
        i, out = batch + 1, []
        j = i - 1
        while j > i - (i & -i):
            out.append(j - 1)
            j -= j & -j
        return out

    @staticmethod
    def living_folders(batch: int) -> list[int]:
        """The batches whose folders together hold the state after this batch."""
        i, out = batch + 1, []
        while i > 0:
            out.append(i - 1)
            i -= i & -i
        return out

    def apply(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for old in self.covered(number - 1) if number > 0 else []:
            path, system = self._path(spark, old)
            system.delete(path, True)
        state = fold(batch, self.scope, self.fields)
        parts = [spark.read.parquet(self._folder(k)) for k in self.covered(number)]
        if parts:
            state = merged(reduce(DataFrame.unionByName, parts, state), self.scope)
        state.write.mode("overwrite").parquet(self._folder(number))

    def _path(self, spark: SparkSession, batch: int):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(batch))
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def run(self, stream: DataFrame) -> DataFrame:
        """Reads all that is there and returns the state after the last batch."""
        query = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        last, spark = query.lastProgress["batchId"] if query.lastProgress else 0, stream.sparkSession
        while last > 0:
            path, system = self._path(spark, last)
            if system.exists(path):
                break
            last -= 1
        parts = [spark.read.parquet(self._folder(k)) for k in self.living_folders(last)]
        return merged(reduce(DataFrame.unionByName, parts), self.scope)


def closed_windows(stream: DataFrame, root: str, at: str, width: str, delay: str, by: str) -> DataFrame:
    """Counts of tumbling event-time windows per `by`, written once each is closed by the watermark; read back as a table."""
    counted = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay).groupBy(F.window("__at", width).alias("w"), by).agg(F.count("*").alias("n"))
    flat = counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")
    query = flat.writeStream.outputMode("append").format("parquet").option("path", f"{root}/windows").option("checkpointLocation", f"{root}/windows-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(flat.schema).parquet(f"{root}/windows")
