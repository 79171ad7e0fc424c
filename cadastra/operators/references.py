"""References to records that do not exist (problem 1)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.session import salted_join, shuffle_partitions, sized_join

#: Buckets of the key space for each shuffle partition; more buckets mean smaller windows.
BUCKETS_PER_PARTITION = 16
_NEVER = "0001-01-01 00:00:00"


def orphan_keys(references: DataFrame, parents: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Keys that some reference uses at a time at which no parent had them.

    references: `keys`, `at` (time of the reference; the same constant everywhere if time does not matter).
    parents: `keys`, `since` (first time at which the parent counts; NULL for one that is known but does not count) and
    perhaps `seen` (when one that does not count came).
    Result: `keys`, `since` (NULL if no parent has the key), `n_refs`; one row per key, hot keys included.

    Keys may be of any type, so the parents' keys are numbered: within a bucket (a hash of the key) every distinct key of
    the parents gets the next integer in order of arrival, and the references' keys are looked up in that dictionary. The
    integers of the parents that count are compressed into runs of consecutive ones. A reference is matched as of the
    last run that starts at or before it, and as of the last parent that came at or before its time, so far the runs
    reached then. What is beyond the end of the run, or of its part that was there, or not in the dictionary at
    all, has no parent. Both sides are one row per key before they are numbered or matched, with partial aggregation
    before the shuffle, so a key with a third of all references is one row here.

    NULL keys refer to nothing and give no row; a NULL `at` is before every parent.
    """
    buckets = buckets or BUCKETS_PER_PARTITION * shuffle_partitions(references.sparkSession)
    ids = [f"__k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(i) for k, i in zip(keys, ids)]
    bucket = F.pmod(F.xxhash64(*ids), F.lit(buckets)).alias("__bucket")
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    seen = ntz("seen" if "seen" in parents.columns else "since")

    dictionary = parents.select(*named, ntz("since").alias("__since"), seen.alias("__seen")).dropna(subset=ids)
    dictionary = dictionary.select("*", bucket).groupBy("__bucket", *ids).agg(F.min("__since").alias("__since"), F.min("__seen").alias("__seen"))
    arrival = Window.partitionBy("__bucket").orderBy(F.coalesce("__since", "__seen"), *ids)
    numbered = dictionary.withColumn("__pos", F.row_number().over(arrival)).drop("__seen")
    counting = numbered.where("__since is not null")
    in_order = Window.partitionBy("__bucket").orderBy("__pos")
    runs = (
        counting.select("__bucket", "__pos", (F.col("__pos") - F.row_number().over(in_order)).alias("__run"))
        .groupBy("__bucket", "__run")
        .agg(F.min("__pos").alias("__pos"), F.max("__pos").alias("__end"))
    )
    used = references.select(*named, F.coalesce(ntz("at"), F.lit(_NEVER).cast("timestamp_ntz")).alias("__time")).dropna(subset=ids)
    used = used.select("*", bucket).groupBy("__bucket", *ids).agg(F.min("__time").alias("__time"), F.count("*").alias("__n"))

    marks = [
        runs.select("__bucket", F.lit(0).alias("__kind"), "__pos", "__end"),
        counting.select("__bucket", F.lit(1).alias("__kind"), F.col("__since").alias("__time"), F.col("__pos").alias("__came")),
        used.join(numbered, ["__bucket", *ids], "left").select("__bucket", F.lit(2).alias("__kind"), "__pos", "__time", *ids, "__since", "__n"),
    ]
    both = marks[2].unionByName(marks[1], allowMissingColumns=True).unionByName(marks[0], allowMissingColumns=True)
    until = lambda *order: Window.partitionBy("__bucket").orderBy(*order, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("__came", F.last("__came", ignorenulls=True).over(until("__time"))).withColumn("__end", F.last("__end", ignorenulls=True).over(until("__pos")))
    in_run = F.col("__pos") <= F.least("__end", "__came")
    reached = F.coalesce(in_run & F.col("__end").isNotNull() & F.col("__came").isNotNull(), F.lit(False))
    return matched.where((F.col("__kind") == 2) & ~reached).select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], F.col("__since").alias("since"), F.col("__n").alias("n_refs"))


def judged_rows(references: DataFrame, parents: DataFrame, keys: list[str], spread: list[Column]) -> DataFrame:
    """`references` with __orphan: whether their parent did not exist at their time.

    See orphan_keys for `references`, `parents` and `keys`. `spread` names what tells the rows of one key apart: hot keys
    are cut by its hash. A key that fails at its earliest reference may be there for later ones, which an exact
    comparison of times decides. The failing keys are found when this is called. Repeated rows come out as often as they come in; NULL keys are no orphans.
    """
    verdict = orphan_keys(references, parents, keys).select(*keys, F.col("since").alias("__since"), F.lit(True).alias("__late"))
    orphan = F.col("__late") & (F.col("__since").isNull() | F.col("at").isNull() | (F.col("at") < F.col("__since")))
    return sized_join(references, verdict, keys, spread, "left_outer").select(*references.columns, F.coalesce(orphan, F.lit(False)).alias("__orphan"))


def orphan_rows(references: DataFrame, parents: DataFrame, keys: list[str], spread: list[Column]) -> DataFrame:
    """The rows of `references` whose parent did not exist at their time; columns as in `references` (see judged_rows)."""
    return judged_rows(references, parents, keys, spread).where("__orphan").drop("__orphan")


def snapshot_parents(snapshot: DataFrame, key: str) -> DataFrame:
    """Every entity of a snapshot table: ref_id, since (first sight where it is available in the latest generation of its instance, else NULL), seen."""
    rows = snapshot.select("catalog_instance_id", "published_generation", F.col(key).alias("ref_id"), "available", "first_seen_at")
    latest = rows.groupBy("catalog_instance_id").agg(F.max("published_generation").alias("__latest"))
    placed = salted_join(rows, latest, ["catalog_instance_id"], [F.col("ref_id")])
    now = F.col("available") & (F.col("published_generation") == F.col("__latest"))
    return placed.select("ref_id", F.when(now, F.col("first_seen_at")).alias("since"), F.col("first_seen_at").alias("seen"))


#: Keys of the references of all tables together: the field, then for credits the instance and generation, then the id.
_KEYS = ["src_field", "scope", "ref_id"]
_OUT = ["src_table", "src_field", "period", "row_key"]


def _described(rows: DataFrame, *more: str) -> DataFrame:
    """_OUT of references, of which table and period follow from the other columns, so they are not shuffled; and `more`."""
    credit = F.col("src_field") == "artist_id"
    source = F.when(credit, "catalog_track_artists").otherwise("collection_items")
    period = F.when(credit, F.nullif(F.substring_index("scope", "/", -1), F.lit(""))).otherwise(F.date_format("at", "yyyy-MM"))
    return rows.select(source.alias("src_table"), "src_field", period.alias("period"), "row_key", *more)


def catalogue_references(artists: DataFrame, albums: DataFrame, tracks: DataFrame, credits: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All references of the catalogue and all that they may refer to, as (references, parents) with _KEYS.

    References have `at` and row_key besides. Credits look in their own instance and generation, items in the latest
    generation of any instance. A credit without instance or generation finds no artist.
    """
    always = F.lit(_NEVER).cast("timestamp_ntz")
    # the instance is never empty in a parent
    scope = F.concat(F.coalesce("catalog_instance_id", F.lit("")), F.lit("/"), F.coalesce(F.col("published_generation").cast("string"), F.lit("")))
    credit = credits.where("artist_id is not null").select(
        F.lit("artist_id").alias("src_field"),
        scope.alias("scope"),
        F.col("artist_id").alias("ref_id"),
        always.alias("at"),
        F.concat_ws("/", "catalog_instance_id", "published_generation", "track_id", "position", "role").alias("row_key"),
    )
    item = items.select("id", "added_at", F.expr("stack(2, 'track_id', track_id, 'provider_album_id', provider_album_id) AS (src_field, ref_id)")).where("ref_id is not null")
    item = item.select("src_field", F.lit("").alias("scope"), "ref_id", F.col("added_at").alias("at"), F.col("id").alias("row_key"))
    known = artists.where("catalog_instance_id is not null and published_generation is not null")
    parents = known.select(F.lit("artist_id").alias("src_field"), scope.alias("scope"), F.col("artist_id").alias("ref_id"), F.when(F.col("available"), always).alias("since"), always.alias("seen"))
    for field, snapshot, key in (("track_id", tracks, "track_id"), ("provider_album_id", albums, "album_id")):
        parents = parents.unionByName(snapshot_parents(snapshot, key).select(F.lit(field).alias("src_field"), F.lit("").alias("scope"), "ref_id", "since", "seen"))
    return credit.unionByName(item), parents


def dangling_references(artists: DataFrame, albums: DataFrame, tracks: DataFrame, credits: DataFrame, items: DataFrame) -> DataFrame:
    """Every row with a reference to a missing, deleted or later entity: src_table, src_field, period, row_key; distinct.

    Credits look for an available artist in their own instance and generation; items for a track or album that is
    available in the latest generation of any instance and was first seen by the time of `added_at`.
    """
    references, parents = catalogue_references(artists, albums, tracks, credits, items)
    return _described(orphan_rows(references, parents, _KEYS, [F.col("row_key")])).distinct()


def dangling_report(artists: DataFrame, albums: DataFrame, tracks: DataFrame, credits: DataFrame, items: DataFrame) -> DataFrame:
    """Per table, field and period: distinct referring rows and those that dangle, counted in one pass."""
    references, parents = catalogue_references(artists, albums, tracks, credits, items)
    rows = _described(judged_rows(references, parents, _KEYS, [F.col("row_key")]), "__orphan").groupBy(*_OUT).agg(F.bool_or("__orphan").alias("__orphan"))
    return rows.groupBy(*_OUT[:3]).agg(F.count("*").alias("n_rows"), F.count_if("__orphan").alias("n_orphans"))
