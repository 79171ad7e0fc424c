"""Session set-up, reliable checkpoints and skew-proof joins."""

import operator
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least and most parts of a key in salted_join; in between, one for every SHARE shuffle partitions.
FEWEST_SALTS, MOST_SALTS, SHARE = 8, 128, 8
#: Most bytes of a side that is broadcast after it was measured.
BROADCAST_BYTES = 8 << 20


def local_session(cores: int | str = "*", app: str = "cadastra", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the session comes from spark-submit and its own settings hold."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once, so that they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="cadastra-package-")) / "cadastra.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared checkpoint folder, so a lost executor never has it recomputed.

    See shared_folder for the place.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only on one machine (a local master) a temporary one is made where none is set; on a cluster that is an error, since
    executors would write where the others cannot read.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cadastra-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, *by: str) -> DataFrame:
    """`df` computed once and written as a table in the shared folder, of which later reads take only the columns and parts they need.

    by: columns of few values whose rows are kept apart, so that a filter on them reads no others. Rows are not shuffled.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` in at least as many partitions as the cluster has cores.

    Tables of enough files stay as they are; the rows of a few unsplittable ones are shuffled by the hash of `by`, so that
    costly work on each row does not run in a task or two.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *by)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salts(spark: SparkSession) -> int:
    """Copies of the small side, and parts of each key of the large side, in salted_join: more on a larger cluster."""
    return max(FEWEST_SALTS, min(MOST_SALTS, shuffle_partitions(spark) // SHARE))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[Column], how: str = "inner") -> DataFrame:
    """`big` joined with `small` on `on`, each key of `big` cut into parts by a hash of `spread` (see salts).

    One key may hold a third of the rows of `big`: its rows go to so many tasks instead of one, and adaptive execution may
    split those again. `small` is copied as often, so it should be the side with few rows per key (a verdict per
    key, a row per instance). how: inner, left_outer, left_semi or left_anti. Nulls in `on` match nothing. The part is a
    hash of row content, so a retried task computes the same.
    """
    parts = salts(big.sparkSession)
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def sized_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[Column], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """`big` joined with `small` on `on`; `small` is computed first and broadcast if it has at most `most` bytes, else the join is salted.

    So `big` is not shuffled where few keys are asked for. Runs a job when called. how: inner or left_outer.
    """
    kept = checkpointed(small)
    row = reduce(operator.add, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in kept.columns], F.lit(8 * len(kept.columns)))
    size = kept.agg(F.sum(row.cast("bigint"))).first()[0] or 0
    return big.join(F.broadcast(kept), on, how) if size <= most else salted_join(big, kept, on, spread, how)
