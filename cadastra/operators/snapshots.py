"""What changed between full snapshots (problem 2)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.session import salted_join


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as text, each with its length before it; NULL differs from every text."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """`keys` and change_kind (added, removed, changed) between two sets of rows.

    A full outer join on `keys` of canonical row hashes: a missing side is an addition or a removal, unequal hashes a
    change. Rows repeated with the same key count once; if their compared columns differ, the smallest hash holds on
    either side. Rows with a null key are no records and give nothing. Only keys and hashes are shuffled; keys are
    unique after the partial aggregation, so no key is hot.
    """

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, row_hash(compared).alias(name)).dropna(subset=keys).groupBy(*keys).agg(F.min(name).alias(name))

    both = hashed(old, "__old").join(hashed(new, "__new"), keys, "full_outer")
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return both.select(*keys, kind.alias("change_kind")).where("change_kind is not null")


def complete_scans(scans: DataFrame) -> DataFrame:
    """Complete scans with their place in their instance: scan_id, catalog_instance_id, next_id (null for the last), first.

    Ordered by started_at, then scan_id; scans without a start come first. Scan rows repeated with the same id count once.
    """
    done = scans.where("status = 'complete'").groupBy("scan_id").agg(F.min("catalog_instance_id").alias("catalog_instance_id"), F.min("started_at").alias("started_at"))
    order = Window.partitionBy("catalog_instance_id").orderBy(F.col("started_at").asc_nulls_first(), "scan_id")
    return done.select("scan_id", F.lead("scan_id").over(order).alias("next_id"), F.row_number().over(order).alias("place"))


def scan_changes(scans: DataFrame, entities: DataFrame) -> DataFrame:
    """Per complete scan, what differs from the previous complete scan of its instance.

    scan_id (the later scan), entity_type, entity_id, change_kind. Entities of other scans, and of none, are left out. A
    scan without any entity removes all. The first scan of an instance gives no rows. One scan may hold a third of all
    entities: the scan's row is copied to several salts, the entities are spread by their id.
    """
    compared = ["metadata_fp", "media_fp", "artwork_fp"]
    rows = entities.select("scan_id", "entity_type", "entity_id", *compared)
    placed = salted_join(rows, complete_scans(scans), ["scan_id"], [F.col("entity_id")])
    keys = ["scan_id", "entity_type", "entity_id"]
    old = placed.where("next_id is not null").select(F.col("next_id").alias("scan_id"), "entity_type", "entity_id", *compared)
    new = placed.where("place > 1").select(*keys, *compared)
    return snapshot_diff(old, new, keys, compared)


def scan_change_counts(scans: DataFrame, entities: DataFrame) -> DataFrame:
    """Changes per scan, entity type and kind."""
    return scan_changes(scans, entities).groupBy("scan_id", "entity_type", "change_kind").agg(F.count("*").alias("n"))
