"""Links from tracks to analysis items, their evidence, and batches of vectors."""

import struct
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.canonical import canonical
from cadastra.functions.text import identity_text
from cadastra.operators.ranks import with_position
from cadastra.session import salted_join

# The greatest difference of durations of one recording, and the most items of a batch.
TOLERANCE_MS, MOST_VECTORS, MOST_SCALARS = 3000, 250, 500


def links(tracks: DataFrame, mapping: DataFrame, items: DataFrame) -> DataFrame:
    """track_id, analysis_id, status: ready with an item, pending with an id that has none yet, missing without an id."""
    mapped = tracks.select("track_id").distinct().join(mapping.select("track_id", "analysis_id"), "track_id", "left")
    known = items.select("analysis_id").distinct().withColumn("__known", F.lit(True))
    status = F.when(F.col("analysis_id").isNull(), "missing").when(F.col("__known"), "ready").otherwise("pending")
    return salted_join(mapped, known, ["analysis_id"], [F.col("track_id")], "left_outer").select("track_id", "analysis_id", status.alias("status"))


def link_counts(rows: DataFrame) -> DataFrame:
    """One row of counters of link states."""
    ready = F.col("status") == "ready"
    return rows.agg(
        F.count("*").alias("total"), F.count_if(ready).alias("usable"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_distinct(F.when(ready, F.col("analysis_id"))).alias("usable_ids"),
    )


def group_sizes(rows: DataFrame, key: str) -> DataFrame:
    """One row: groups of a key, groups of more than one row, rows of the largest (0 for none)."""
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    return sizes.agg(F.count("*").alias("n_groups"), F.count_if(F.col("__n") > 1).alias("n_shared"), F.coalesce(F.max("__n"), F.lit(0)).cast("bigint").alias("largest"))


def suspects(occurrences: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """analysis_id of groups of tracks that can hardly be one recording, and why.

    occurrences: analysis_id, title, artist, duration_ms, recording_ids (array). Suspect are durations further apart than the
    tolerance, several titles with several artists, and known recordings without a common id. Everything is a partial
    aggregate: a recording is common if as many occurrences have it as have any.
    """
    base = occurrences.where("analysis_id is not null")
    ids = F.array_distinct(F.coalesce("recording_ids", F.array().cast("array<string>")))
    groups = base.groupBy("analysis_id").agg(
        F.count("*").alias("n"), (F.max("duration_ms") - F.min("duration_ms")).alias("__range"), F.count_distinct(identity_text(F.col("title"))).alias("__titles"),
        F.count_distinct(F.nullif(identity_text(F.col("artist")), F.lit(""))).alias("__artists"), F.count_if(F.size(ids) > 0).alias("__with"),
    ).where("n > 1")
    shared = base.select("analysis_id", F.explode(ids).alias("__id")).groupBy("analysis_id", "__id").agg(F.count("*").alias("__n")).groupBy("analysis_id").agg(F.max("__n").alias("__most"))
    known = groups.join(shared, "analysis_id", "left")
    duration, text = F.coalesce(F.col("__range") > tolerance_ms, F.lit(False)), (F.col("__titles") > 1) & (F.col("__artists") > 1)
    recording = (F.col("__with") > 1) & F.coalesce(F.col("__most") < F.col("__with"), F.lit(False))
    return known.select("analysis_id", "n", duration.alias("duration_conflict"), text.alias("text_conflict"), recording.alias("recording_conflict")).where("duration_conflict or text_conflict or recording_conflict")


def evidence(rows: DataFrame, available: bool = True, enabled: bool = True) -> DataFrame:
    """analysis_id, n, verdict of the tracks that share an analysis.

    rows: analysis_id, fingerprint. complete for single tracks, if fingerprints do not exist at all, or if all are equal; pending where one is missing
    (validation_unavailable if evidence is disabled); disagreement where two differ. Fingerprints agree if they are equal, so no pairs are compared.
    """
    groups = rows.where("analysis_id is not null").groupBy("analysis_id").agg(F.count("*").alias("n"), F.count(F.nullif(F.col("fingerprint"), F.lit(""))).alias("__have"), (F.min(F.nullif(F.col("fingerprint"), F.lit(""))) != F.max(F.nullif(F.col("fingerprint"), F.lit("")))).alias("__differ"))
    verdict = (
        F.when((F.col("n") == 1) | F.lit(not available), "complete")
        .when(F.lit(not enabled), "validation_unavailable")
        .when(F.col("__have") < F.col("n"), "pending")
        .when(F.col("__differ"), "disagreement")
        .otherwise("complete")
    )
    return groups.select("analysis_id", "n", verdict.alias("verdict"))


def coverage(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, present, total, ratio: in how many rows each field is there. One aggregation, then a row per field."""
    counted = rows.agg(F.count("*").alias("total"), *[F.count_if(present).alias(name) for name, present in fields.items()])
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("present")) for name in fields]))
    ratio = F.when(F.col("total") > 0, F.bround(F.col("s.present") / F.col("total"), 6)).otherwise(F.lit(0.0))
    return counted.select(stacked.alias("s"), "total").select("s.field", "s.present", "total", ratio.alias("ratio"))


def batch_index(vectors: DataFrame, item_id: str = "analysis_id") -> DataFrame:
    """Places of vectors in their batches: `item_id`, batch, offset, byte_length, dimensions; vectors: `item_id` (distinct), dimensions.

    In order of ids, MOST_VECTORS to a batch, each after the bytes of those before it. Every vector is in a batch; a window
    never has more rows than one.
    """
    numbered = with_position(vectors.select(item_id, "dimensions"), [item_id], "__place")
    placed = numbered.withColumns({"batch": F.floor((F.col("__place") - 1) / MOST_VECTORS), "byte_length": F.col("dimensions").cast("bigint") * 4})
    before = Window.partitionBy("batch").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(item_id, "batch", F.coalesce(F.sum("byte_length").over(before), F.lit(0)).alias("offset"), "byte_length", "dimensions")


def pack_batch(rows: Iterable[tuple[str, bytes | None, int, str]], family: str, generation: int, label: str = "cadastra-f32le-v1") -> bytes:
    """A batch of vectors (id, bytes, dimensions, checksum) for the wire: header length, canonical JSON header, bytes.

    Rows without bytes have no vector and are left out; more than MOST_VECTORS vectors are an error. `label` names the
    format in the header; a consumer of another name passes its own.
    """
    vectors = sorted((row for row in rows if row[1]), key=lambda row: row[0])
    if len(vectors) > MOST_VECTORS:
        raise ValueError(f"more than {MOST_VECTORS} vectors")
    data, index = bytearray(), []
    for item, blob, dimensions, checksum in vectors:
        if len(blob) != 4 * dimensions:
            raise ValueError("a vector does not have its dimensions")
        index.append({"analysis_id": item, "offset": len(data), "byte_length": len(blob), "dimensions": dimensions, "checksum": checksum})
        data += blob
    header = canonical({"format": label, "family": family, "generation": generation, "vectors": index}).encode()
    return struct.pack("<I", len(header)) + header + bytes(data)


def sorted_scope_fingerprint(ids: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """`groups`, n, fingerprint of a set of ids that does not depend on their order: sums of their hashes, no list of them."""
    each = F.sha2(F.col(key), 256)
    words = [F.sum(F.conv(F.substring(each, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(5)]
    return ids.select(*groups, key).distinct().groupBy(*groups).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*"), *words), 256).alias("fingerprint"))
