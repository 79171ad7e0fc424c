"""Queries of the normaliser: the latest generations as raw provider records, normalised, with oracle SQL on the tables they came from."""

from pyspark.sql import functions as F

from cadastra.operators import normalize
from cadastra.operators.ranks import with_position
from cadastra.session import salted_join
from cadastra.sources import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _latest(spark, d, name):
    rows = table(spark, d, name)
    latest = rows.groupBy("catalog_instance_id").agg(F.max("published_generation").alias("published_generation"))
    return salted_join(rows, latest, ["catalog_instance_id", "published_generation"], [F.xxhash64("payload")])


def _in(column):
    return F.concat("catalog_instance_id", F.lit("/"), column)


def _records(rows, *fields):
    """(ordinal, record): rows in order of their id, as JSON of their fields."""
    placed = with_position(rows.select(*fields).distinct(), ["Id"], "ordinal")
    return placed.select("ordinal", F.to_json(F.struct(*[c for c in placed.columns if c != "ordinal"])).alias("record"))


def _normalised(spark, d):
    """The catalogue's latest generations as one provider would deliver them, normalised."""
    scope = ["catalog_instance_id", "track_id"]
    tracks = _latest(spark, d, "catalog_tracks").where("available")
    credits = _latest(spark, d, "catalog_track_artists").select(*scope, "position", "role", "artist_id", "display_name").distinct()
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "artist_id", "display_name"))), lambda c: F.struct(c["artist_id"].alias("Id"), c["display_name"].alias("Name"), c["role"].alias("Role")))
    tracks = tracks.join(credits.groupBy(*scope).agg(listed.alias("ArtistItems")), scope, "left")
    track = _records(
        tracks, _in("track_id").alias("Id"), F.col("title").alias("Name"), _in("album_id").alias("AlbumId"), "ArtistItems", F.col("artist_display").alias("Artist"), F.col("album_artist_display").alias("AlbumArtist"),
        F.col("disc_number").alias("ParentIndexNumber"), F.col("track_number").cast("string").alias("IndexNumber"), (F.col("duration_ms") * 10_000).alias("RunTimeTicks"), F.col("content_kind").alias("type"),
        F.col("release_type").alias("releaseType"), "streamable", "downloadable", F.col("catalog_instance_id").alias("LibraryId"),
    )
    album = _records(
        _latest(spark, d, "catalog_albums").where("available"), _in("album_id").alias("Id"), F.col("name").alias("Name"), F.col("sort_name").alias("SortName"), F.col("album_artist_display").alias("AlbumArtist"),
        F.col("release_type").alias("albumType"), F.col("content_kind").alias("type"), F.get_json_object("payload", "$.year").alias("ProductionYear"),
    )
    library = _records(table(spark, d, "catalog_tracks"), F.col("catalog_instance_id").alias("Id"), F.lit("Music").alias("Name"))
    return normalize.normalise(library, album, track, "test")


_T = lambda c: f"nullif(trim(nfc_normalize({c})), '')"
#: Anything named after audio is music.
_KIND = "CASE WHEN content_kind LIKE '%podcast%' THEN 'podcast' WHEN content_kind IN ('music', 'song', 'track') OR content_kind LIKE '%audio%' THEN 'music' WHEN content_kind LIKE '%video%' THEN 'video' ELSE content_kind END AS content_kind"
_LATEST = lambda t: f"(SELECT t.* FROM catalog_{t} t JOIN (SELECT catalog_instance_id, max(published_generation) AS published_generation FROM catalog_{t} GROUP BY 1) USING (catalog_instance_id, published_generation))"
_RAW = f"""
WITH t AS (SELECT DISTINCT catalog_instance_id || '/' || track_id AS track_id, catalog_instance_id || '/' || album_id AS album_id, catalog_instance_id AS library_id, {_T('title')} AS title, {_T('artist_display')} AS artist_display,
  {_T('album_artist_display')} AS own_artist, CAST(disc_number AS BIGINT) AS disc_number, CAST(track_number AS BIGINT) AS track_number, duration_ms, {_KIND}, release_type, streamable, downloadable FROM {_LATEST('tracks')} WHERE available),
a AS (SELECT DISTINCT catalog_instance_id || '/' || album_id AS album_id, {_T('name')} AS name, {_T('sort_name')} AS sort_name, {_T('album_artist_display')} AS album_artist_display, release_type, {_KIND}, CAST(json_extract_string(payload, '$.year') AS BIGINT) AS year FROM {_LATEST('albums')} WHERE available),
n AS (SELECT album_id, count(*) AS track_count, count(DISTINCT coalesce(nullif(disc_number, 0), 1)) AS disc_count, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM t WHERE album_id IS NOT NULL GROUP BY 1),
i AS (SELECT album_id, arg_min((own_artist, release_type, content_kind), track_id) AS x FROM t WHERE album_id IS NOT NULL AND album_id NOT IN (SELECT album_id FROM a) GROUP BY 1),
every AS (SELECT * FROM a UNION ALL SELECT album_id, 'Unknown Album', NULL, x[1], x[2], 'music', NULL FROM i),
c AS (SELECT catalog_instance_id || '/' || track_id AS track_id, position AS p, role, artist_id, {_T('display_name')} AS display_name,
  row_number() OVER (PARTITION BY catalog_instance_id, track_id ORDER BY position, role, artist_id NULLS FIRST, display_name) - 1 AS position FROM (SELECT DISTINCT catalog_instance_id, track_id, position, role, artist_id, display_name FROM {_LATEST('track_artists')})),
credit AS (SELECT c.*, t.library_id, t.album_id FROM c JOIN t USING (track_id) WHERE display_name IS NOT NULL)
"""


@query(f"""{_RAW} SELECT track_id, t.album_id, title, artist_display, coalesce(own_artist, e.album_artist_display) AS album_artist_display, disc_number, track_number, t.duration_ms, t.content_kind, coalesce(t.release_type, e.release_type) AS release_type,
streamable, downloadable, t.content_kind = 'music' AS analysis_eligible, track_count AS track_total, disc_count AS disc_total FROM t LEFT JOIN every e USING (album_id) LEFT JOIN n USING (album_id)""")
def normal_tracks(spark, d):
    names = ["track_id", "album_id", "title", "artist_display", "album_artist_display", "disc_number", "track_number", "duration_ms", "content_kind", "release_type", "streamable", "downloadable", "analysis_eligible", "track_total", "disc_total"]
    return _normalised(spark, d)["tracks"].select(*names)


@query(f"{_RAW} SELECT album_id, name, sort_name, album_artist_display, release_type, content_kind, year, coalesce(track_count, 0) AS track_count, coalesce(disc_count, 0) AS disc_count, duration_ms FROM every LEFT JOIN n USING (album_id)")
def normal_albums(spark, d):
    rows = _normalised(spark, d)["albums"]
    return rows.select("album_id", "name", "sort_name", "album_artist_display", "release_type", "content_kind", "year", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("track_count", "disc_count")], "duration_ms")


@query(f"{_RAW} SELECT track_id, position, artist_id, display_name, role, CASE WHEN artist_id IS NULL THEN 'derived_display_name' ELSE 'provider_id' END AS identity_provenance FROM credit")
def normal_credits(spark, d):
    rows = _normalised(spark, d)["track_artists"]
    native = F.when(F.col("identity_provenance") == "provider_id", F.col("artist_id"))
    return rows.select("track_id", "position", native.alias("artist_id"), "display_name", "role", "identity_provenance")


@query(f"{_RAW} SELECT artist_id, arg_min(display_name, (track_id, position)) AS name FROM credit WHERE artist_id IS NOT NULL GROUP BY 1")
def normal_artists(spark, d):
    return _normalised(spark, d)["artists"].where("identity_provenance = 'provider_id'").select("artist_id", "name")


@query(f"""{_RAW}, own AS (SELECT 'track' AS entity_type, track_id AS entity_id, library_id FROM t UNION SELECT 'album', album_id, library_id FROM t WHERE album_id IS NOT NULL UNION SELECT 'artist', artist_id, library_id FROM credit WHERE artist_id IS NOT NULL)
SELECT * FROM own WHERE NOT starts_with(entity_id, 'derived:')""")
def normal_memberships(spark, d):
    """Libraries of tracks, albums and artists; artists without an id of the provider are left to the tests."""
    return _normalised(spark, d)["entity_libraries"].where("NOT startswith(entity_id, 'derived:')")


@query(f"{_RAW}, p AS (SELECT CASE WHEN title IS NULL THEN 'missing id or title' END AS problem FROM t) SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1 UNION ALL SELECT 'tracks', count(*) FROM t")
def normal_problems(spark, d):
    """What must stop a publication, beside the number of tracks."""
    record = F.to_json(F.struct(_in("track_id").alias("Id"), F.col("title").alias("Name")))
    raw = _latest(spark, d, "catalog_tracks").where("available").select("catalog_instance_id", "track_id", "title").distinct().select(F.lit(0).cast("bigint").alias("ordinal"), record.alias("record"))
    read = normalize.read_records(raw, "tracks")
    return normalize.check_tracks(read).unionByName(read.agg(F.count("*").alias("n")).select(F.lit("tracks").alias("problem"), "n"))
