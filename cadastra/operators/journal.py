"""Generations and their change journals."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.ranks import with_position
from cadastra.session import checkpointed, salted_join

# Order of entity types in a publication, and the least number of kept events.
ENTITY_ORDER = ("library", "artist", "album", "track")
LEAST_KEPT = 1000


def generation_diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str], payload: str | None = None) -> DataFrame:
    """Changes from one generation to the next: `keys`, operation (upsert or delete), is_new.

    A full outer join on the keys; a row is an upsert if it is new or any of `compared` differs (NULL equals NULL).
    Repeated rows count once.
    """
    more = [payload] if payload else []

    def side(df: DataFrame, name: str) -> DataFrame:
        fields = F.struct(*compared)
        return df.groupBy(*keys).agg(F.max(fields).alias(name), *([F.max(payload).alias(f"{name}_payload")] if payload else []))

    both = side(old, "__old").join(side(new, "__new"), keys, "full_outer")
    operation = F.when(F.col("__new").isNull(), "delete").when(~F.col("__new").eqNullSafe(F.col("__old")), "upsert")
    out = [*keys, operation.alias("operation"), F.col("__old").isNull().alias("is_new"), *([F.col("__new_payload").alias(payload)] if more else [])]
    return both.select(*out).where("operation is not null")


def with_change_order(changes: DataFrame, head: int = 0) -> DataFrame:
    """Changes (entity_type, entity_id, operation) with seq after `head`, in publication order.

    Rekeys, then upserts by entity type and id, then deletes by entity type in reverse and id. Numbered over ranges.
    """
    place = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in ENTITY_ORDER]), F.col("entity_type")), F.lit(0)).cast("int")
    phase = F.when(F.col("operation") == "rekey", 0).when(F.col("operation") == "upsert", 1).otherwise(2)
    keyed = changes.withColumns({"__phase": phase, "__place": F.when(phase == 2, -place).otherwise(place)})
    return with_position(keyed, ["__phase", "__place", "entity_id"], "seq").withColumn("seq", F.col("seq") + head).drop("__phase", "__place")


def change_counts(changes: DataFrame) -> DataFrame:
    """Per entity type: upserts, deletes, rekeys."""
    return changes.groupBy("entity_type").agg(*[F.count_if(F.col("operation") == o).alias(f"n_{o}") for o in ("upsert", "delete", "rekey")])


def reactivated(added: DataFrame, history: DataFrame, keys: list[str], at: str, first: str) -> DataFrame:
    """Added entities (`keys`, `at`) that were there before: history has for each entity (`keys`) the `first` time it was seen."""
    return added.join(history.select(*keys, first), keys).where(F.col(first) < F.col(at)).drop(first)


def change_page(changes: DataFrame, after: int, limit: int, head: int | None = None) -> DataFrame:
    """The next changes after a cursor by seq, at most up to `head`; a repeated change counts once."""
    rows = changes.where(F.col("seq") > after) if head is None else changes.where(F.col("seq").between(after + 1, head))
    return rows.dropDuplicates(["seq"]).orderBy("seq").limit(limit)


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next `limit` rows and one more by `keys`, after the given key values; the one more says that there are others."""
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for k, value in zip(keys, after):
            beyond = beyond | (equal & (F.col(k) > value))
            equal = equal & (F.col(k) == value)
        rows = rows.where(beyond)
    return rows.orderBy(*keys).limit(limit + 1)


def retention_floor(head: int, entities: int) -> int:
    """The seq up to which events are dropped: the last max(1000, 2 x entities) are kept."""
    return max(0, head - max(LEAST_KEPT, 2 * entities))


def compacted(changes: DataFrame, entities: DataFrame) -> DataFrame:
    """Changes of each instance's current epoch beyond its floor.

    entities: catalog_instance_id, n (entities of the instance, NULL or missing is 0). Instances are joined with salts.
    """
    state = changes.groupBy("catalog_instance_id").agg(F.max(F.struct("generation", "epoch"))["epoch"].alias("epoch"), F.max(F.struct("generation", "seq"))["seq"].alias("__any"))
    heads = changes.groupBy("catalog_instance_id", "epoch").agg(F.max("seq").alias("head"))
    current = state.select("catalog_instance_id", "epoch").join(heads, ["catalog_instance_id", "epoch"]).join(entities, "catalog_instance_id", "left")
    kept = F.greatest(F.lit(LEAST_KEPT), 2 * F.coalesce("n", F.lit(0)))
    floor = current.select("catalog_instance_id", "epoch", F.greatest(F.lit(0), F.col("head") - kept).alias("__floor"))
    rows = salted_join(changes, floor, ["catalog_instance_id", "epoch"], [F.col("seq")])
    return rows.where(F.col("seq") > F.col("__floor")).drop("__floor")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` in the place of those with their keys."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def prunable_generations(generations: DataFrame, active: DataFrame, pins: DataFrame) -> DataFrame:
    """Generations before the active one that no lease or pin holds: catalog_instance_id, published_generation."""
    own = generations.select("catalog_instance_id", "published_generation").distinct()
    older = own.join(active.select("catalog_instance_id", F.col("published_generation").alias("__active")), "catalog_instance_id").where("published_generation < __active")
    return older.join(pins.select("catalog_instance_id", "published_generation"), ["catalog_instance_id", "published_generation"], "left_anti").drop("__active")


def rekeyed(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """`rows` with the ids in `column` replaced by the mapping (old_id, new_id); other ids stay. Hot ids are salted."""
    spread = [F.xxhash64(*rows.columns)]
    renamed = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("__new_id"))
    return salted_join(rows, renamed, [column], spread, "left_outer").withColumn(column, F.coalesce("__new_id", column)).select(*rows.columns)


def payload_bytes(rows: DataFrame, groups: list[str], text: str = "payload", overhead: int = 96) -> DataFrame:
    """Estimated bytes of a snapshot: UTF-8 bytes of the payloads and an overhead for each row."""
    return rows.groupBy(*groups).agg((F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + overhead)).cast("bigint").alias("n_bytes"), F.count("*").alias("n_rows"))


def nearest_around(events: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """For each mark (key, at) the last event at or before it and the first at or after it, by the key.

    Marks and events share one order, which is cut into ranges over all tasks: both neighbours are running values within
    a range, and those of the ranges before and after are carried in. A key with a third of all rows is many ranges; only
    a row per key and range is numbered by key. The ranges are kept in the checkpoint folder.
    """
    none = F.lit(None).cast(events.schema["at"].dataType)
    both = events.select(key, "at", F.col("at").alias("__event"), F.lit(0).alias("__kind")).unionByName(marks.select(key, "at", none.alias("__event"), F.lit(1).alias("__kind")))
    named = both.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")))
    placed = checkpointed(named.repartitionByRange("__key", "at").withColumn("__part", F.spark_partition_id()))
    edges = placed.groupBy("__key", "__part").agg(F.max("__event").alias("__last"), F.min("__event").alias("__first"))
    parts = lambda order: Window.partitionBy("__key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("__key", "__part", F.last("__last", True).over(parts(F.asc("__part"))).alias("__before"), F.last("__first", True).over(parts(F.desc("__part"))).alias("__after"))
    within = lambda order: Window.partitionBy("__key", "__part").orderBy(order, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    near = salted_join(placed.select("*", F.last("__event", True).over(within(F.asc("at"))).alias("__b"), F.last("__event", True).over(within(F.desc("at"))).alias("__a")).where("__kind = 1"), carried, ["__key", "__part"], [F.col("at")])
    return near.select(key, "at", F.coalesce("__b", "__before").alias("before"), F.coalesce("__a", "__after").alias("after")).distinct()
