"""Queries of the coverage operators over whole tables, with oracle SQL. Tables the data lack are made of columns they have, as said at each."""

from pyspark.sql import functions as F

from cadastra.operators import analysis, coverage
from cadastra.plans import normal
from cadastra.sources import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


# An analysis is named by an artist; tracks are mapped to that of the item that holds them; media fingerprints stand for audio fingerprints.
_PARTS = """
WITH t AS (SELECT track_id, max(duration_ms) AS duration_ms, min(title) AS title, max(CASE WHEN duration_ms IS NOT NULL THEN media_fp END) AS fp, max(last_seen_at) AS seen_at FROM catalog_tracks GROUP BY 1),
m AS (SELECT track_id, min(coalesce(artist, '')) AS analysis_id FROM collection_items WHERE track_id IS NOT NULL GROUP BY 1),
i AS (SELECT DISTINCT name AS analysis_id FROM catalog_artists),
l AS (SELECT t.*, m.analysis_id, CASE WHEN m.analysis_id IS NULL THEN 'missing' WHEN i.analysis_id IS NOT NULL THEN 'ready' ELSE 'pending' END AS status FROM t LEFT JOIN m USING (track_id) LEFT JOIN i USING (analysis_id)),
s AS (SELECT analysis_id FROM l WHERE analysis_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND max(duration_ms) - min(duration_ms) > 3000),
g AS (SELECT analysis_id, count(*) AS n, count(fp) AS have, count(DISTINCT fp) AS prints FROM l WHERE status = 'ready' GROUP BY 1),
f AS (SELECT l.track_id, l.analysis_id, status, CASE WHEN n = 1 THEN NULL WHEN have < n THEN 'chromaprint_evidence_pending' WHEN prints > 1 THEN 'chromaprint_disagreement' END AS flag, n IS NOT NULL AND s.analysis_id IS NOT NULL AS bad, n IS NOT NULL AS ready
  FROM l LEFT JOIN g USING (analysis_id) LEFT JOIN s USING (analysis_id)),
p AS (SELECT track_id, analysis_id, status, ready AND flag IS NULL AND NOT bad AS evidence_complete, list_filter([flag, CASE WHEN bad THEN 'provider_evidence_conflict' END], lambda x: x IS NOT NULL) AS conflict_flags,
  CASE WHEN coalesce(flag = 'chromaprint_disagreement', false) THEN 'needs_repair' WHEN bad THEN 'needs_review' WHEN flag IS NOT NULL THEN 'provisional' ELSE 'none' END AS review_state FROM f)
"""


def _parts(spark, d):
    rows = table(spark, d, "catalog_tracks")
    print_ = F.max(F.when(F.col("duration_ms").isNotNull(), F.col("media_fp")))
    tracks = rows.groupBy("track_id").agg(F.max("duration_ms").alias("duration_ms"), F.min("title").alias("title"), print_.alias("fingerprint"), F.max("last_seen_at").alias("updated_at"))
    mapping = table(spark, d, "collection_items").where("track_id is not null").groupBy("track_id").agg(F.min(F.coalesce("artist", F.lit(""))).alias("analysis_id"))
    return tracks, mapping, table(spark, d, "catalog_artists").select(F.col("name").alias("analysis_id"))


def _projection(spark, d):
    tracks, mapping, items = _parts(spark, d)
    occurrences = tracks.join(mapping, "track_id").select("analysis_id", F.lit("").alias("title"), F.lit("").alias("artist"), "duration_ms", F.array().cast("array<string>").alias("recording_ids"))
    return coverage.projection(tracks, mapping, items, tracks, analysis.suspects(occurrences))


@query(f"{_PARTS} SELECT * FROM p")
def projection(spark, d):
    return _projection(spark, d)


@query(f"""{_PARTS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ready') AS usable, count(*) FILTER (WHERE status = 'ready' AND evidence_complete) AS verified, count(*) FILTER (WHERE status = 'ready' AND NOT evidence_complete) AS provisional,
count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE review_state IN ('needs_repair', 'needs_review')) AS suspect, count(*) FILTER (WHERE status = 'missing') AS missing, count(DISTINCT analysis_id) FILTER (WHERE status = 'ready') AS usable_ids FROM p""")
def link_states(spark, d):
    return coverage.link_states(_projection(spark, d))


@query("SELECT count(*) AS total, count(cover_art_id) AS covers, count(artwork_fp) AS artworks FROM catalog_albums")
def item_presence(spark, d):
    """Covers and artworks of albums, as vectors of items are counted."""
    return coverage.presence(table(spark, d, "catalog_albums"), {"covers": "cover_art_id", "artworks": "artwork_fp"})


# The profile of a track is in the state that the length of its title says; tracks without a duration have none.
_STATES = ("ready", "pending", "pending_interactive", "failed", "skipped_no_file", "stale", "missing")


@query(f"""WITH t AS (SELECT track_id, max(duration_ms) AS duration_ms, min(title) AS title FROM catalog_tracks GROUP BY 1),
p AS (SELECT track_id, duration_ms, CASE WHEN duration_ms IS NOT NULL THEN [{', '.join(f"'{s}'" for s in _STATES)}][length(title) % 7 + 1] END AS status FROM t)
SELECT count(*) AS tracks, count(status) AS stored, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status IN ('pending', 'pending_interactive')) AS pending, count(*) FILTER (WHERE status = 'failed') AS failed,
count(*) FILTER (WHERE status = 'skipped_no_file') AS skipped, count(*) FILTER (WHERE status IS NULL OR status IN ('stale', 'missing')) AS needs_attention FROM p""")
def profile_states(spark, d):
    tracks = _parts(spark, d)[0]
    status = F.element_at(F.array(*map(F.lit, _STATES)), F.char_length("title") % 7 + 1)
    return coverage.profile_states(tracks, tracks.where("duration_ms is not null").select("track_id", status.alias("status")))


@query(f"""{_PARTS}, c AS (SELECT t.track_id, m.track_id AS mapped, t.fp, t.seen_at FROM t LEFT JOIN m USING (track_id)),
n AS (SELECT count(*) AS eligible, count(mapped) AS mapped, count(*) FILTER (WHERE mapped IS NOT NULL AND fp IS NOT NULL) AS fingerprinted, max(seen_at) FILTER (WHERE mapped IS NOT NULL) AS latest FROM c)
SELECT eligible, mapped, eligible - mapped AS unmapped, fingerprinted, mapped - fingerprinted AS unfingerprinted, CASE WHEN mapped > 0 THEN fingerprinted / mapped ELSE 0 END AS part, latest FROM n""")
def readiness(spark, d):
    tracks, mapping, _ = _parts(spark, d)
    return coverage.readiness(tracks, mapping, tracks)


_NONE = ("disc_title", "year", "genres", "external_ids", "sample_rate", "bit_depth", "channels", "file_size", "replay_gain", "cover_art_id")
_SOME = {"album_id": "t.album_id", "track_number": "track_number", "disc_number": "disc_number", "track_total": "n.album_id", "disc_total": "n.album_id", "duration_ms": "t.duration_ms", "release_type": "coalesce(t.release_type, e.release_type)", "media_type": "t.content_kind"}
_COUNTS = ", ".join([f"count({sql}) AS {name}" for name, sql in _SOME.items()] + [f"0 AS {name}" for name in (*_NONE, "container", "bit_rate")])
_NAMES = [*_SOME, *_NONE, "container", "bit_rate", "artist_credits", "library_membership"]


@query(f"""{normal._RAW}, k AS (SELECT count(*) AS total, {_COUNTS}, (SELECT count(DISTINCT track_id) FROM credit) + count(*) FILTER (WHERE t.track_id NOT IN (SELECT track_id FROM c) AND artist_display IS NOT NULL) AS artist_credits, count(*) AS library_membership FROM t LEFT JOIN every e USING (album_id) LEFT JOIN n USING (album_id))
""" + " UNION ALL ".join(f"SELECT '{name}' AS field, {name} AS present, total, round_even({name} / total, 6) AS ratio FROM k" for name in _NAMES))
def catalogue_coverage(spark, d):
    """All fields of the normalised catalogue; its raw records have no technical properties, gains, covers or disc titles."""
    return coverage.catalogue_coverage(normal._normalised(spark, d))


_IDS = lambda column, name, of: f"sha256('{{\"{name}\":' || to_json((SELECT list({column} ORDER BY {column}) FROM {of})) || '}}')"


@query(f"""{normal._RAW}, ends AS (SELECT * FROM (SELECT track_id FROM t ORDER BY track_id LIMIT 64) UNION SELECT * FROM (SELECT track_id FROM t ORDER BY track_id DESC LIMIT 64)), libs AS (SELECT DISTINCT library_id FROM t)
SELECT (SELECT count(*) FROM libs) AS library_count, (SELECT count(*) FROM t) AS track_count, (SELECT count(*) FROM t) AS mapped_track_count, {_IDS('library_id', 'library_ids', 'libs')} AS library_ids_fp, {_IDS('track_id', 'track_ids', 'ends')} AS sample_fp""")
def scope_evidence(spark, d):
    """The fingerprints that SQL can make; those that need no order are left to the tests."""
    return coverage.scope_evidence(normal._normalised(spark, d), "test").drop("tracks_fp", "scope_fp")


@query(f"""{_PARTS} SELECT (SELECT count(*) FROM p) AS actual_link_count, (SELECT count(*) FROM i) AS actual_item_count, (SELECT count(*) FROM p WHERE analysis_id IS NOT NULL AND analysis_id NOT IN (SELECT analysis_id FROM i)) AS orphan_link_count,
(SELECT count(*) FROM p WHERE track_id NOT IN (SELECT track_id FROM catalog_tracks WHERE available)) AS out_of_catalogue_link_count, false AS integrity""")
def projection_integrity(spark, d):
    rows, items = _projection(spark, d), _parts(spark, d)[2].distinct()
    available = table(spark, d, "catalog_tracks").where("available").select("track_id").distinct()
    return coverage.projection_integrity(rows, items, available, 0, 0)
