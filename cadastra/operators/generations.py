"""Immutable generations in Parquet with a pointer that is replaced last."""

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.journal import ENTITY_ORDER, LEAST_KEPT, generation_diff, with_change_order


@dataclass(frozen=True)
class State:
    """What readers of one catalogue instance see."""

    catalog_instance_id: str
    generation: int = 0
    epoch: str = ""
    head_seq: int = 0
    floor_seq: int = 0
    counts: dict = field(default_factory=dict)


class Moved(RuntimeError):
    """Another writer published first."""


class GenerationStore:
    """Tables of a catalogue under `root`: <table>/instance=…/generation=… and journal/instance=…/epoch=…/generation=…

    A generation is written whole and never changed. Its pointer, a small JSON file, is written beside the old one and
    renamed over it, so readers see all of a generation or none. A publication names the generation it started from and
    fails if that is no longer current. Files are reached through Hadoop, so `root` may lie on any of its file systems.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _dir(self, table: str, instance: str, *parts: str) -> str:
        return "/".join([self.root, table, f"instance={instance}", *parts])

    def state(self, instance: str) -> State:
        path = self._path(self._dir("state", instance, "pointer.json"))
        if not self._files.exists(path):
            return State(instance)
        stream = self._files.open(path)
        try:
            return State(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _point(self, before: State, after: State) -> None:
        folder = self._dir("state", before.catalog_instance_id)
        written, pointer = self._path(f"{folder}/{uuid.uuid4().hex}.tmp"), self._path(f"{folder}/pointer.json")
        stream = self._files.create(written)
        stream.write(json.dumps(asdict(after)).encode())
        stream.close()
        claim = self._path(f"{folder}/claim-{after.generation}-{after.epoch}")
        if self.state(before.catalog_instance_id) != before or not self._files.createNewFile(claim):
            self._files.delete(written, False)
            raise Moved(before.catalog_instance_id)
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(written.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(written), context.makeQualified(pointer), kinds)

    def read(self, table: str, instance: str, generation: int | None = None) -> DataFrame:
        """A table of a generation, the current one by default."""
        n = self.state(instance).generation if generation is None else generation
        return self.spark.read.parquet(self._dir(table, instance, f"generation={n}"))

    def journal(self, instance: str) -> DataFrame:
        """Changes of the current epoch between floor and head: seq, generation, entity_type, entity_id, operation, payload."""
        now = self.state(instance)
        rows = self.spark.read.option("basePath", self._dir("journal", instance)).parquet(self._dir("journal", instance, f"epoch={now.epoch}"))
        return rows.where(F.col("seq").between(now.floor_seq + 1, now.head_seq)).drop("epoch")

    def publish(self, instance: str, entities: DataFrame, compared: list[str]) -> tuple[State, dict[str, int]]:
        """A new generation of entities (entity_type, entity_id, payload, `compared`) and its changes; (state, counts).

        Without any change the current state stays and nothing is written.
        """
        before = self.state(instance)
        first = before.generation == 0
        after = before.generation + 1
        old = entities.where(F.lit(False)) if first else self.read("entities", instance)
        changes = with_change_order(generation_diff(old, entities, ["entity_type", "entity_id"], compared, "payload"), before.head_seq)
        epoch = before.epoch or uuid.uuid4().hex
        folder = self._dir("journal", instance, f"epoch={epoch}", f"generation={after}")
        changes.drop("is_new").write.mode("overwrite").parquet(folder)
        written = self.spark.read.parquet(folder)
        counts = {f"{r['entity_type']} {r['operation']}": r["n"] for r in written.groupBy("entity_type", "operation").agg(F.count("*").alias("n")).collect()}
        if not counts and not first:
            self._files.delete(self._path(folder), True)
            return before, {}
        entities.dropDuplicates(["entity_type", "entity_id"]).write.mode("overwrite").parquet(self._dir("entities", instance, f"generation={after}"))
        kept = {r["entity_type"]: r["n"] for r in self.read("entities", instance, after).groupBy("entity_type").agg(F.count("*").alias("n")).collect()}
        head = before.head_seq + sum(counts.values())
        floor = max(before.floor_seq, head - max(LEAST_KEPT, 2 * sum(kept.values())))
        state = replace(before, generation=after, epoch=epoch, head_seq=head, floor_seq=floor, counts={t: kept.get(t, 0) for t in ENTITY_ORDER})
        self._point(before, state)
        return state, counts

    def prune(self, instance: str, pinned: set[int] = frozenset()) -> list[int]:
        """Drops the generations before the current one that no lease pins; their numbers."""
        now, folder = self.state(instance), self._path(self._dir("entities", instance))
        found = [int(f.getPath().getName().partition("=")[2]) for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        old = sorted(n for n in found if n < now.generation and n not in pinned)
        for n in old:
            self._files.delete(self._path(self._dir("entities", instance, f"generation={n}")), True)
        return old
