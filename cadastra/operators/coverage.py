"""How far a catalogue is covered: links and their evidence, items, profiles, fingerprints, fields, and the scope of a provider."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.canonical import fingerprint_of, json_fingerprint
from cadastra.operators.analysis import coverage, links, sorted_scope_fingerprint
from cadastra.session import salted_join

# Flags and review states of links, first and last ids of a sample, and ids that prove a scope.
DISAGREEMENT, PENDING, CONFLICT = "chromaprint_disagreement", "chromaprint_evidence_pending", "provider_evidence_conflict"
OPEN_REVIEW = ("needs_repair", "needs_review")
SAMPLE_ENDS, LEAST_PROOF = 64, 12
PROFILE_STATES = {"ready": ("ready",), "pending": ("pending", "pending_interactive"), "failed": ("failed",), "skipped": ("skipped_no_file",)}
NO_PROFILE = ("stale", "missing")


def projection(tracks: DataFrame, mapping: DataFrame, items: DataFrame, prints: DataFrame, suspects: DataFrame) -> DataFrame:
    """The links of a catalogue: track_id, analysis_id, status, evidence_complete, conflict_flags (sorted), review_state.

    tracks: track_id. mapping: track_id, analysis_id. items: analysis_id. prints: track_id, fingerprint. suspects:
    analysis_id (see analysis.suspects). Tracks of one ready analysis vouch for each other: alone it is complete; with a
    fingerprint missing its evidence is pending and the link provisional; with two fingerprints that differ it needs repair;
    else it is complete. A suspect analysis is never complete and needs review, or repair if it needs that anyway. Groups are
    aggregated before they are joined to their tracks with salts, so an analysis of a third of all tracks is one row.
    """
    base = links(tracks, mapping, items)
    known = base.join(prints.select("track_id", F.nullif("fingerprint", F.lit("")).alias("__print")).groupBy("track_id").agg(F.max("__print").alias("__print")), "track_id", "left")
    ready = known.where("status = 'ready'").groupBy("analysis_id").agg(F.count("*").alias("__n"), F.count("__print").alias("__have"), (F.min("__print") != F.max("__print")).alias("__differ"))
    bad = suspects.select("analysis_id").distinct().withColumn("__bad", F.lit(True))
    groups = ready.join(bad, "analysis_id", "left")
    joined = salted_join(known, groups, ["analysis_id"], [F.col("track_id")], "left_outer")
    alone, missing = F.col("__n") == 1, F.col("__have") < F.col("__n")
    flag = F.when(alone, None).when(missing, PENDING).when(F.col("__differ"), DISAGREEMENT)
    suspect, repair = F.coalesce("__bad", F.lit(False)), F.coalesce(flag == DISAGREEMENT, F.lit(False))
    flags = F.array_sort(F.array_compact(F.array(flag, F.when(suspect, CONFLICT))))
    review = F.when(repair, "needs_repair").when(suspect, "needs_review").when(flag.isNotNull(), "provisional").otherwise("none")
    return joined.select("track_id", "analysis_id", "status", (F.col("__n").isNotNull() & flag.isNull() & ~suspect).alias("evidence_complete"), flags.alias("conflict_flags"), review.alias("review_state"))


def link_states(rows: DataFrame) -> DataFrame:
    """One row of counters of a projection's links."""
    ready, done = F.col("status") == "ready", F.col("evidence_complete")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(ready).alias("usable"), F.count_if(ready & done).alias("verified"), F.count_if(ready & ~done).alias("provisional"),
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if((F.col("status") == "suspect") | F.col("review_state").isin(*OPEN_REVIEW)).alias("suspect"),
        F.count_if(F.col("status") == "missing").alias("missing"), F.count_distinct(F.when(ready, F.col("analysis_id"))).alias("usable_ids"),
    )


def presence(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: all rows, and for each name those in which its column is there."""
    return rows.agg(F.count("*").alias("total"), *[F.count(column).alias(name) for name, column in columns.items()])


def profile_states(tracks: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: tracks (track_id, distinct), those with a profile (track_id, status), by state, and those that need one."""
    both = tracks.select("track_id").join(profiles.select(F.col("track_id").alias("__has"), "status"), F.col("track_id") == F.col("__has"), "left")
    states = [F.count_if(F.col("status").isin(*values)).alias(name) for name, values in PROFILE_STATES.items()]
    needs = F.count_if(F.col("__has").isNull() | F.col("status").isin(*NO_PROFILE))
    return both.agg(F.count("*").alias("tracks"), F.count("__has").alias("stored"), *states, needs.alias("needs_attention"))


def readiness(tracks: DataFrame, mapping: DataFrame, prints: DataFrame) -> DataFrame:
    """One row: eligible tracks (track_id), mapped ones (mapping: track_id), fingerprinted ones (prints: track_id, fingerprint, updated_at), what is missing, part and latest time."""
    mapped = tracks.select("track_id").join(mapping.select("track_id", F.lit(True).alias("__mapped")), "track_id", "left")
    both = mapped.join(prints.select("track_id", "fingerprint", "updated_at"), "track_id", "left")
    seen = F.col("__mapped") & F.col("fingerprint").isNotNull()
    counted = both.agg(F.count("*").alias("eligible"), F.count("__mapped").alias("mapped"), F.count_if(seen).alias("fingerprinted"), F.max(F.when(F.col("__mapped"), F.col("updated_at"))).alias("latest"))
    short = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.col(b))
    part = F.when(F.col("mapped") > 0, F.col("fingerprinted") / F.col("mapped")).otherwise(0.0)
    return counted.select("eligible", "mapped", short("eligible", "mapped").alias("unmapped"), "fingerprinted", short("mapped", "fingerprinted").alias("unfingerprinted"), part.alias("part"), "latest")


def catalogue_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """field, present, total, ratio of the fields of a normalised catalogue's tracks (see normalize.normalise)."""
    there = lambda c: F.col(c).isNotNull()
    inner = lambda path: F.get_json_object("payload", f"$.{path}").isNotNull()
    plain = ("album_id", "track_number", "disc_number", "track_total", "disc_total", "disc_title", "duration_ms", "release_type", "year", "cover_art_id")
    fields: dict[str, Column] = {c: there(c) for c in plain} | {"media_type": there("content_kind"), "genres": F.size("genres") > 0, "external_ids": there("external_ids") & (F.col("external_ids") != "{}")}
    fields |= {name: inner(f"audio_properties.{key}") for name, key in (("container", "container"), ("bit_rate", "bit_rate"), ("sample_rate", "sample_rate"), ("bit_depth", "bit_depth"), ("channels", "channels"), ("file_size", "size"))}
    gains = [inner(f"replay_gain.{key}") for key in ("track_gain_db", "track_peak", "album_gain_db", "album_peak")]
    fields |= {"replay_gain": gains[0] | gains[1] | gains[2] | gains[3], "artist_credits": F.size("credits") > 0, "library_membership": F.size("library_ids") > 0}
    return coverage(tables["tracks"], fields)


def scope_evidence(tables: dict[str, DataFrame], provider: str) -> DataFrame:
    """One row of what tells a provider's catalogue from another without its ids: counts and fingerprints.

    library_ids_fp and sample_fp are hashes of sorted lists: libraries, and the first and last SAMPLE_ENDS track ids.
    tracks_fp and scope_fp, of all track ids and of all their memberships, are sums of hashes, which need no order and
    no list in one place.
    """
    tracks = tables["tracks"].select("track_id")
    members = tables["entity_libraries"].where("entity_type = 'track'").select("entity_id", "library_id").distinct()
    pair = members.select(F.to_json(F.struct("entity_id", "library_id")).alias("pair"), "entity_id", "library_id")
    used = F.array_sort(F.collect_set("library_id"))
    counted = members.agg(used.alias("__used"), F.count_distinct("entity_id").alias("mapped_track_count"))
    visible = tables["libraries"].agg(used.alias("__visible"))
    ends = [tracks.orderBy(order("track_id")).limit(SAMPLE_ENDS) for order in (F.asc, F.desc)]
    sample = ends[0].union(ends[1]).distinct().agg(F.array_sort(F.collect_list("track_id")).alias("track_ids"))
    listed = lambda column, name: json_fingerprint(F.to_json(F.struct(column.alias(name))))
    about = counted.select("mapped_track_count", F.when(F.size("__used") > 0, F.col("__used")).otherwise(visible.scalar()).alias("ids"))
    one = sorted_scope_fingerprint(tracks, "track_id", []).select(F.col("n").alias("track_count"), F.concat(F.lit(f"{provider}:"), "fingerprint").alias("__tracks"))
    scope = sorted_scope_fingerprint(pair, "pair", []).select(F.col("fingerprint").alias("scope_fp"))
    row = about.withColumns({"one": one.select(F.struct("*")).scalar(), "scope_fp": scope.scalar(), "track_ids": sample.scalar()})
    return row.select(
        F.size("ids").cast("bigint").alias("library_count"), F.col("one.track_count").alias("track_count"), "mapped_track_count",
        listed(F.col("ids"), "library_ids").alias("library_ids_fp"), listed(F.col("track_ids"), "track_ids").alias("sample_fp"), F.sha2("one.__tracks", 256).alias("tracks_fp"), "scope_fp",
    )


def verified_scope(evidence: DataFrame, tracks: DataFrame, library_ids: list[str], track_ids: list[str]) -> DataFrame:
    """One row: whether a client that names these libraries and these tracks sees the catalogue of scope_evidence.

    All libraries must be named, and enough tracks (LEAST_PROOF, or as many as there are), all of which are there.
    """
    ids = sorted({x for x in track_ids if x})
    matched = tracks.where(F.col("track_id").isin(ids)).agg(F.count_distinct("track_id").alias("n"))
    needed = F.least(F.lit(LEAST_PROOF), F.col("track_count"))
    row = evidence.select(
        (F.col("library_ids_fp") == fingerprint_of({"library_ids": sorted(set(library_ids))})).alias("library_verified"), needed.alias("required_track_count"), F.lit(len(ids)).cast("bigint").alias("submitted_track_count"), matched.scalar().alias("matched_track_count"),
    )
    enough = (F.col("required_track_count") > 0) & (F.col("submitted_track_count") >= F.col("required_track_count"))
    rows = row.withColumn("tracks_verified", enough & (F.col("matched_track_count") == F.col("submitted_track_count")))
    return rows.withColumn("verified", F.col("library_verified") & F.col("tracks_verified"))


def projection_integrity(rows: DataFrame, items: DataFrame, tracks: DataFrame, expected_items: int, expected_links: int, complete: bool = True) -> DataFrame:
    """One row: counts of a projection's items and links, links to no item, links of no track, and whether all is as it should be."""
    none = rows.where("analysis_id is not null").join(items.select("analysis_id"), "analysis_id", "left_anti").agg(F.count("*").alias("n"))
    outside = rows.join(tracks.select("track_id"), "track_id", "left_anti").agg(F.count("*").alias("n"))
    counted = rows.agg(F.count("*").alias("actual_link_count")).withColumns({"actual_item_count": items.agg(F.count("*").alias("n")).scalar(), "orphan_link_count": none.scalar(), "out_of_catalogue_link_count": outside.scalar()})
    sound = (F.col("actual_item_count") == expected_items) & (F.col("actual_link_count") == expected_links) & (F.col("orphan_link_count") == 0) & (F.col("out_of_catalogue_link_count") == 0)
    return counted.withColumn("integrity", sound & (F.lit(complete) | ((F.col("actual_item_count") == 0) & (F.col("actual_link_count") == 0))))
