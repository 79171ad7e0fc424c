"""Queries of the catalogue operators, over whole tables, with their oracle SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions import numbers, text
from cadastra.functions.canonical import canonical_json
from cadastra.operators import analysis, browse, identity, journal, normalize
from cadastra.operators.ranks import with_group_position, with_position
from cadastra.operators.snapshots import row_hash, scan_changes
from cadastra.session import salted_join
from cadastra.sources import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query with its oracle SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_VIEW = """
WITH latest AS (SELECT catalog_instance_id, max(published_generation) AS published_generation FROM catalog_tracks GROUP BY 1),
now_ AS (SELECT DISTINCT t.catalog_instance_id, t.published_generation, track_id, album_id, title, artist_display, album_artist_display, disc_number, track_number, duration_ms, cover_art_id
  FROM catalog_tracks t JOIN latest USING (catalog_instance_id, published_generation) WHERE available),
al AS (SELECT catalog_instance_id, published_generation, album_id, min(name) AS album, min(album_artist_display) AS aa FROM catalog_albums WHERE available GROUP BY ALL),
view_ AS (SELECT n.catalog_instance_id, n.track_id, n.album_id, n.title, n.artist_display AS artist, coalesce(n.album_artist_display, al.aa, n.artist_display) AS album_artist, al.album, n.disc_number, n.track_number, n.duration_ms, n.cover_art_id
  FROM now_ n LEFT JOIN al USING (catalog_instance_id, published_generation, album_id))
"""
_ALBUMS = "albums AS (SELECT album, album_artist, min(track_id) AS first_track, count(*) AS n_tracks, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM view_ WHERE album IS NOT NULL GROUP BY 1, 2)"
_ARTISTS = "artists AS (SELECT artist, count(*) AS n_tracks, count(DISTINCT nullif(album, '')) AS n_albums FROM view_ WHERE artist IS NOT NULL GROUP BY 1)"


def _view(spark, d):
    return browse.track_view(table(spark, d, "catalog_tracks"), table(spark, d, "catalog_albums"))


@query(f"{_VIEW}, {_ALBUMS} SELECT *, (SELECT count(*) FROM albums) AS total FROM albums ORDER BY lower(album), lower(album_artist) NULLS LAST, album, album_artist NULLS LAST LIMIT 36 OFFSET 36")
def browse_albums(spark, d):
    return browse.browse_albums(_view(spark, d), 36, 36)


@query(f"{_VIEW} SELECT catalog_instance_id, track_id, title, artist, album, (SELECT count(*) FROM view_) AS total FROM view_ ORDER BY lower(title) NULLS LAST, catalog_instance_id, track_id LIMIT 50")
def browse_tracks(spark, d):
    return browse.browse_tracks(_view(spark, d))


@query(f"{_VIEW}, {_ARTISTS} SELECT *, (SELECT count(*) FROM artists) AS total FROM artists ORDER BY lower(artist), artist LIMIT 50")
def browse_artists(spark, d):
    return browse.browse_artists(_view(spark, d))


@query(f"{_VIEW}, {_ALBUMS} SELECT * FROM albums")
def all_albums(spark, d):
    return browse.albums_of(_view(spark, d))


@query(f"{_VIEW} SELECT count(*) AS n_tracks, count(DISTINCT (album, coalesce(album_artist, ''))) FILTER (WHERE album IS NOT NULL) AS n_albums, count(DISTINCT artist) AS n_artists FROM view_")
def library_stats(spark, d):
    return browse.library_stats(_view(spark, d))


@query(f"{_VIEW} SELECT * FROM view_ WHERE lower(strip_accents(concat_ws(' ', title, artist, album, album_artist))) LIKE '%manana%' AND lower(strip_accents(concat_ws(' ', title, artist, album, album_artist))) LIKE '%si%'")
def search_tokens(spark, d):
    return browse.found(_view(spark, d), "mañana SI")


@query("SELECT DISTINCT id, title, artist, album FROM collection_items WHERE title ILIKE '%harbour%' OR artist ILIKE '%harbour%' OR album ILIKE '%harbour%' ORDER BY id, title, artist, album LIMIT 100")
def search_any(spark, d):
    rows = table(spark, d, "collection_items").select("id", "title", "artist", "album").distinct()
    return browse.any_like(rows, "harbour", ["title", "artist", "album"], 100)


@query("""SELECT catalog_instance_id, album_id, track_id, row_number() OVER (PARTITION BY catalog_instance_id, album_id ORDER BY coalesce(nullif(disc_number, 0), 1), coalesce(track_number, 1000000), track_id) AS place
FROM (SELECT DISTINCT catalog_instance_id, album_id, track_id, disc_number, track_number FROM catalog_tracks t JOIN (SELECT catalog_instance_id, max(published_generation) AS published_generation FROM catalog_tracks GROUP BY 1) USING (catalog_instance_id, published_generation) WHERE available)""")
def album_order(spark, d):
    rows = _view(spark, d).select("catalog_instance_id", "album_id", "track_id", "disc_number", "track_number")
    order = [F.coalesce(F.nullif(F.col("disc_number"), F.lit(0)), F.lit(1)), F.coalesce("track_number", F.lit(1_000_000)), F.col("track_id")]
    return with_group_position(rows, ["catalog_instance_id", "album_id"], order, "place").drop("disc_number", "track_number")


# generations and journals

_KEYS = ["catalog_instance_id", "track_id"]
_FPS = ["metadata_fp", "media_fp", "artwork_fp"]


def _neighbours(spark, d):
    """Rows of catalog_tracks with the place of their generation in their instance: (older side, newer side) of each pair."""
    rows = table(spark, d, "catalog_tracks").where("available").select("catalog_instance_id", "published_generation", "track_id", *_FPS)
    all_ = table(spark, d, "catalog_tracks").select("catalog_instance_id", "published_generation").distinct()
    order = Window.partitionBy("catalog_instance_id").orderBy("published_generation")
    following = all_.withColumn("next_generation", F.lead("published_generation").over(order)).where("next_generation is not null")
    first = all_.groupBy("catalog_instance_id").agg(F.min("published_generation").alias("__first"))
    old = salted_join(rows, following, ["catalog_instance_id", "published_generation"], [F.col("track_id")]).select("catalog_instance_id", F.col("next_generation").alias("generation"), "track_id", *_FPS)
    new = salted_join(rows, first, ["catalog_instance_id"], [F.col("track_id")]).where("published_generation > __first").select("catalog_instance_id", F.col("published_generation").alias("generation"), "track_id", *_FPS)
    return old, new


_DIFF = """
WITH r AS (SELECT DISTINCT catalog_instance_id, published_generation AS g, track_id, metadata_fp, media_fp, artwork_fp FROM catalog_tracks WHERE available),
gs AS (SELECT catalog_instance_id, g, lead(g) OVER (PARTITION BY catalog_instance_id ORDER BY g) AS next_, lag(g) OVER (PARTITION BY catalog_instance_id ORDER BY g) AS prev_ FROM (SELECT DISTINCT catalog_instance_id, published_generation AS g FROM catalog_tracks)),
o AS (SELECT r.*, gs.next_ AS generation FROM r JOIN gs USING (catalog_instance_id, g) WHERE gs.next_ IS NOT NULL),
n AS (SELECT r.*, g AS generation FROM r JOIN gs USING (catalog_instance_id, g) WHERE gs.prev_ IS NOT NULL),
diff AS (SELECT coalesce(n.catalog_instance_id, o.catalog_instance_id) AS catalog_instance_id, coalesce(n.generation, o.generation) AS generation, coalesce(n.track_id, o.track_id) AS track_id,
  CASE WHEN n.track_id IS NULL THEN 'delete' WHEN o.track_id IS NULL OR (n.metadata_fp, n.media_fp, n.artwork_fp) IS DISTINCT FROM (o.metadata_fp, o.media_fp, o.artwork_fp) THEN 'upsert' END AS operation, o.track_id IS NULL AS is_new
  FROM n FULL OUTER JOIN o ON n.catalog_instance_id = o.catalog_instance_id AND n.generation = o.generation AND n.track_id = o.track_id),
changes AS (SELECT * FROM diff WHERE operation IS NOT NULL)
"""


def _changes(spark, d):
    return journal.generation_diff(*_neighbours(spark, d), ["catalog_instance_id", "generation", "track_id"], _FPS)


@query(f"{_DIFF} SELECT * FROM changes")
def generation_diff(spark, d):
    return _changes(spark, d)


@query("SELECT entity_type, count(*) FILTER (WHERE operation = 'upsert') AS n_upsert, count(*) FILTER (WHERE operation = 'delete') AS n_delete, count(*) FILTER (WHERE operation = 'rekey') AS n_rekey FROM catalog_changes GROUP BY 1")
def change_counts(spark, d):
    return journal.change_counts(table(spark, d, "catalog_changes"))


@query("""WITH placed AS (SELECT scan_id, catalog_instance_id, row_number() OVER (PARTITION BY catalog_instance_id ORDER BY started_at, scan_id) AS place FROM catalog_scans WHERE status = 'complete'),
r AS (SELECT DISTINCT catalog_instance_id, place, entity_type, entity_id FROM catalog_scan_entities JOIN placed USING (scan_id, catalog_instance_id))
SELECT scan_id, entity_type, entity_id FROM r JOIN placed USING (catalog_instance_id, place) WHERE EXISTS (SELECT 1 FROM r b WHERE b.catalog_instance_id = r.catalog_instance_id AND b.entity_type = r.entity_type AND b.entity_id = r.entity_id AND b.place < r.place - 1)
AND NOT EXISTS (SELECT 1 FROM r b WHERE b.catalog_instance_id = r.catalog_instance_id AND b.entity_type = r.entity_type AND b.entity_id = r.entity_id AND b.place = r.place - 1)""")
def reactivations(spark, d):
    """Entities that a scan brings back: added since the scan before, but seen by an earlier one."""
    scans, entities = table(spark, d, "catalog_scans"), table(spark, d, "catalog_scan_entities")
    order = Window.partitionBy("catalog_instance_id").orderBy("started_at", "scan_id")
    placed = scans.where("status = 'complete'").select("scan_id", "catalog_instance_id", "started_at").withColumn("place", F.row_number().over(order)).drop("started_at")
    keys = ["catalog_instance_id", "entity_type", "entity_id"]
    first = salted_join(entities.select("scan_id", *keys), placed, ["scan_id", "catalog_instance_id"], [F.col("entity_id")]).groupBy(*keys).agg(F.min("place").alias("first_place"))
    added = scan_changes(scans, entities).where("change_kind = 'added'").select("scan_id", "entity_type", "entity_id")
    dated = salted_join(added, placed, ["scan_id"], [F.col("entity_id")])
    return journal.reactivated(dated, first, keys, "place", "first_place").select("scan_id", "entity_type", "entity_id")


@query(f"""{_DIFF} SELECT catalog_instance_id, generation, track_id, operation, row_number() OVER (ORDER BY CASE operation WHEN 'upsert' THEN 1 ELSE 2 END, catalog_instance_id || '/' || generation || '/' || track_id) + 1000 AS seq FROM changes""")
def journal_sequence(spark, d):
    named = _changes(spark, d).withColumns({"entity_type": F.lit("track"), "entity_id": F.concat_ws("/", "catalog_instance_id", "generation", "track_id")})
    return journal.with_change_order(named, 1000).select("catalog_instance_id", "generation", "track_id", "operation", "seq")


@query("SELECT DISTINCT catalog_instance_id, epoch, seq, operation FROM catalog_changes WHERE seq BETWEEN 101 AND 400 AND (catalog_instance_id, epoch) = (SELECT (catalog_instance_id, epoch) FROM catalog_changes GROUP BY catalog_instance_id, epoch ORDER BY count(*) DESC, catalog_instance_id, epoch LIMIT 1) ORDER BY seq LIMIT 50")
def journal_page(spark, d):
    rows = table(spark, d, "catalog_changes").select("catalog_instance_id", "epoch", "seq", "operation")
    largest = rows.groupBy("catalog_instance_id", "epoch").agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "catalog_instance_id", "epoch").limit(1)
    return journal.change_page(rows.join(F.broadcast(largest), ["catalog_instance_id", "epoch"]).drop("__n"), 100, 50, 400)


@query("""WITH e AS (SELECT catalog_instance_id, arg_max(epoch, generation) AS epoch FROM catalog_changes GROUP BY 1), h AS (SELECT catalog_instance_id, epoch, max(seq) AS head FROM catalog_changes JOIN e USING (catalog_instance_id, epoch) GROUP BY ALL),
n AS (SELECT catalog_instance_id, count(DISTINCT (entity_type, entity_id)) AS n FROM catalog_changes GROUP BY 1)
SELECT DISTINCT c.catalog_instance_id, c.epoch, c.seq, c.entity_id FROM catalog_changes c JOIN h USING (catalog_instance_id, epoch) JOIN n USING (catalog_instance_id) WHERE c.seq > greatest(0, head - greatest(1000, 2 * n))""")
def journal_compacted(spark, d):
    rows = table(spark, d, "catalog_changes")
    entities = rows.groupBy("catalog_instance_id").agg(F.count_distinct("entity_type", "entity_id").alias("n"))
    return journal.compacted(rows.select("catalog_instance_id", "epoch", "generation", "seq", "entity_id"), entities).select("catalog_instance_id", "epoch", "seq", "entity_id").distinct()


@query("SELECT DISTINCT artist_id, catalog_instance_id, published_generation FROM catalog_artists WHERE artist_id > '4' ORDER BY artist_id, catalog_instance_id, published_generation LIMIT 101")
def keyset_page(spark, d):
    rows = table(spark, d, "catalog_artists").select("artist_id", "catalog_instance_id", "published_generation").distinct()
    return journal.keyset_page(rows.where(F.col("artist_id") > "4"), ["artist_id", "catalog_instance_id", "published_generation"], None, 100)


@query("SELECT DISTINCT entity_type, entity_id FROM catalog_scan_entities WHERE entity_type > 'album' OR (entity_type = 'album' AND entity_id > '5') ORDER BY 1, 2 LIMIT 101")
def composite_keyset_page(spark, d):
    rows = table(spark, d, "catalog_scan_entities").select("entity_type", "entity_id").distinct()
    return journal.keyset_page(rows, ["entity_type", "entity_id"], ("album", "5"), 100)


@query("""WITH l AS (SELECT catalog_instance_id, max(published_generation) AS g FROM catalog_artists GROUP BY 1), a AS (SELECT DISTINCT catalog_instance_id, published_generation, artist_id, metadata_fp FROM catalog_artists),
new_ AS (SELECT a.* FROM a JOIN l ON a.catalog_instance_id = l.catalog_instance_id AND a.published_generation = l.g), old_ AS (SELECT a.* FROM a JOIN l ON a.catalog_instance_id = l.catalog_instance_id AND a.published_generation < l.g)
SELECT * FROM new_ UNION ALL SELECT * FROM old_ o WHERE NOT EXISTS (SELECT 1 FROM new_ n WHERE n.catalog_instance_id = o.catalog_instance_id AND n.artist_id = o.artist_id)""")
def upsert_rewrite(spark, d):
    rows = table(spark, d, "catalog_artists").select("catalog_instance_id", "published_generation", "artist_id", "metadata_fp").distinct()
    latest = rows.groupBy("catalog_instance_id").agg(F.max("published_generation").alias("__g"))
    placed = salted_join(rows, latest, ["catalog_instance_id"], [F.col("artist_id")])
    new, old = (placed.where(c).drop("__g") for c in ("published_generation = __g", "published_generation < __g"))
    return journal.upserted(old, new, ["catalog_instance_id", "artist_id"])


@query("""WITH g AS (SELECT DISTINCT catalog_instance_id, published_generation FROM catalog_tracks), m AS (SELECT catalog_instance_id, max(published_generation) AS a, min(published_generation) AS p FROM g GROUP BY 1)
SELECT g.* FROM g JOIN m USING (catalog_instance_id) WHERE g.published_generation < m.a AND NOT (g.published_generation = m.p)""")
def prunable_generations(spark, d):
    rows = table(spark, d, "catalog_tracks").select("catalog_instance_id", "published_generation")
    bounds = lambda f: rows.groupBy("catalog_instance_id").agg(f("published_generation").alias("published_generation"))
    return journal.prunable_generations(rows, bounds(F.max), bounds(F.min))


@query("SELECT catalog_instance_id, published_generation, CAST(sum(coalesce(strlen(payload), 0) + 96) AS BIGINT) AS n_bytes, count(*) AS n_rows FROM catalog_tracks GROUP BY 1, 2")
def snapshot_bytes(spark, d):
    return journal.payload_bytes(table(spark, d, "catalog_tracks"), ["catalog_instance_id", "published_generation"])


@query("""SELECT DISTINCT s.catalog_instance_id, s.started_at AS at, (SELECT max(completed_at) FROM catalog_scans b WHERE b.catalog_instance_id = s.catalog_instance_id AND b.status = 'complete' AND b.completed_at <= s.started_at) AS before,
(SELECT min(completed_at) FROM catalog_scans b WHERE b.catalog_instance_id = s.catalog_instance_id AND b.status = 'complete' AND b.completed_at >= s.started_at) AS after FROM catalog_scans s""")
def scans_around(spark, d):
    scans = table(spark, d, "catalog_scans")
    ended = scans.where("status = 'complete' and completed_at is not null").select("catalog_instance_id", F.col("completed_at").alias("at"))
    return journal.nearest_around(ended, scans.select("catalog_instance_id", F.col("started_at").alias("at")), "catalog_instance_id")


# normalising

@query("SELECT id, nullif(regexp_replace(nfc_normalize(title), '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g'), '') AS title FROM (SELECT DISTINCT id, title FROM collection_items)")
def text_cleaned(spark, d):
    return table(spark, d, "collection_items").select("id", "title").distinct().select("id", text.clean(F.col("title")).alias("title"))


@query("SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS k, lower(coalesce(artist, '')) || '::' || lower(coalesce(title, '')) AS album_key FROM (SELECT DISTINCT id, title, artist FROM collection_items)")
def title_keys(spark, d):
    rows = table(spark, d, "collection_items").select("id", "title", "artist").distinct()
    return rows.select("id", text.normal_key(F.col("title")).alias("k"), text.album_key(F.col("artist"), F.col("title")).alias("album_key"))


@query(r"SELECT id, trim(regexp_replace(lower(trim(coalesce(title, ''))), '(\s*\([^)]*(deluxe|japanese|remastered|expanded)[^)]*\)\s*)+$', '', 'g')) AS edition FROM (SELECT DISTINCT id, title FROM collection_items)")
def edition_text(spark, d):
    return table(spark, d, "collection_items").select("id", "title").distinct().select("id", text.edition_text(F.col("title")).alias("edition"))


@query("SELECT DISTINCT scan_id, entity_type, entity_id, sha256(coalesce(CAST(strlen(metadata_fp) AS VARCHAR) || ':' || metadata_fp, '-') || '|' || coalesce(CAST(strlen(media_fp) AS VARCHAR) || ':' || media_fp, '-')) AS fp FROM catalog_scan_entities")
def fingerprints(spark, d):
    return table(spark, d, "catalog_scan_entities").select("scan_id", "entity_type", "entity_id", row_hash(["metadata_fp", "media_fp"]).alias("fp")).distinct()


@query("""SELECT DISTINCT scan_id, entity_type, entity_id, c AS payload, sha256(c) AS fp FROM (SELECT scan_id, entity_type, entity_id, '{' || array_to_string(list_transform(list_sort(json_keys(payload)), lambda k: to_json(k) || ':' || json_extract(payload, '$."' || k || '"')), ',') || '}' AS c FROM catalog_scan_entities)""")
def canonical_payloads(spark, d):
    """Canonical bytes and fingerprints; payloads that differ in formatting only have the same."""
    rows = table(spark, d, "catalog_scan_entities").select("scan_id", "entity_type", "entity_id", canonical_json(F.col("payload")).alias("payload"))
    return rows.distinct().withColumn("fp", F.sha2("payload", 256))


@query("SELECT event_id, greatest(0, CAST(round_even(value * 1000, 0) AS BIGINT)) AS duration_ms, CAST(greatest(0, least(1, (value / 500 - 0.01) / 0.14)) AS DOUBLE) AS energy FROM events")
def durations(spark, d):
    none = F.lit(None).cast("bigint")
    return table(spark, d, "events").select("event_id", numbers.duration_ms(none, none, F.col("value")).alias("duration_ms"), numbers.energy(F.col("value") / 500).alias("energy"))


@query("SELECT id, artist, CASE WHEN k LIKE '%podcast%' THEN 'podcast' WHEN k IN ('music', 'song', 'track') OR k LIKE '%audio%' THEN 'music' WHEN k LIKE '%video%' THEN 'video' ELSE coalesce(nullif(k, ''), 'music') END AS kind FROM (SELECT DISTINCT id, artist, lower(trim(kind)) AS k FROM collection_items)")
def content_kinds(spark, d):
    return table(spark, d, "collection_items").select("id", "artist", "kind").distinct().select("id", "artist", text.content_kind(F.col("kind")).alias("kind"))


@query("""SELECT catalog_instance_id, published_generation, album_id, count(*) AS track_count, count(DISTINCT coalesce(nullif(disc_number, 0), 1)) AS disc_count, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
FROM (SELECT DISTINCT catalog_instance_id, published_generation, album_id, track_id, disc_number, duration_ms FROM catalog_tracks) WHERE album_id IS NOT NULL GROUP BY 1, 2, 3""")
def album_totals(spark, d):
    rows = table(spark, d, "catalog_tracks").select("catalog_instance_id", "published_generation", F.col("album_id").alias("__a"), "track_id", "disc_number", "duration_ms").distinct()
    one = rows.withColumns({"album_id": F.when(F.col("__a").isNotNull(), F.struct("catalog_instance_id", "published_generation", "__a")), "compilation": F.lit(False), "explicit": F.lit(False)})
    return normalize.album_totals(one).select("album_id.catalog_instance_id", "album_id.published_generation", F.col("album_id.__a").alias("album_id"), "track_count", "disc_count", "duration_ms")


@query("""SELECT track_id, arg_max(title, published_generation) AS title FROM (SELECT DISTINCT track_id, catalog_instance_id, published_generation, title FROM catalog_tracks) GROUP BY track_id""")
def last_titles(spark, d):
    rows = table(spark, d, "catalog_tracks").select("track_id", F.col("published_generation").alias("ordinal"), "title")
    return normalize.last_delivered(rows, "track_id").select("track_id", "title")


@query("SELECT provider_album_id, count(DISTINCT id) AS n_items FROM collection_items i WHERE provider_album_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM catalog_albums a WHERE a.album_id = i.provider_album_id) GROUP BY 1")
def albums_without_record(spark, d):
    known = table(spark, d, "catalog_albums").select(F.col("album_id").alias("provider_album_id")).where("provider_album_id is not null").distinct()
    items = table(spark, d, "collection_items").where("provider_album_id is not null").groupBy("provider_album_id").agg(F.count_distinct("id").alias("n_items"))
    return items.join(known, "provider_album_id", "left_anti")


@query("""SELECT DISTINCT * FROM (SELECT catalog_instance_id, 'artist' AS entity_type, artist_id AS entity_id, unnest(from_json(json_extract(payload, '$.library_ids'), '["VARCHAR"]')) AS library_id FROM catalog_artists)""")
def artist_libraries(spark, d):
    ids = F.explode(F.from_json(F.get_json_object("payload", "$.library_ids"), "array<string>")).alias("library_id")
    return table(spark, d, "catalog_artists").select("catalog_instance_id", F.lit("artist").alias("entity_type"), F.col("artist_id").alias("entity_id"), ids).distinct()


@query("""SELECT catalog_instance_id, published_generation, track_id, list(struct_pack(position := position, role := role, artist_id := artist_id) ORDER BY position, role, artist_id) AS credits
FROM (SELECT DISTINCT catalog_instance_id, published_generation, track_id, position, role, artist_id FROM catalog_track_artists) GROUP BY 1, 2, 3""")
def nested_credits(spark, d):
    rows = table(spark, d, "catalog_track_artists").select("catalog_instance_id", "published_generation", "track_id", "position", "role", "artist_id").distinct()
    return rows.groupBy("catalog_instance_id", "published_generation", "track_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", "artist_id"))).alias("credits"))


# states, coverage and links

_PRESENT = ("album_id", "disc_number", "track_number", "duration_ms", "release_type", "cover_art_id", "media_fp", "artwork_fp", "album_artist_display")


@query("WITH t AS (SELECT * FROM catalog_tracks) " + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*) AS total, round_even(count({c}) / count(*), 6) AS ratio FROM t" for c in _PRESENT))
def field_coverage(spark, d):
    return analysis.coverage(table(spark, d, "catalog_tracks"), {c: F.col(c).isNotNull() for c in _PRESENT})


_LINKS = """
WITH t AS (SELECT DISTINCT track_id FROM catalog_tracks), m AS (SELECT track_id, min(provider_album_id) AS x, min(coalesce(artist, '')) AS analysis_id FROM collection_items WHERE track_id IS NOT NULL GROUP BY 1),
i AS (SELECT DISTINCT name AS analysis_id FROM catalog_artists),
links AS (SELECT t.track_id, m.analysis_id, CASE WHEN m.analysis_id IS NULL THEN 'missing' WHEN i.analysis_id IS NOT NULL THEN 'ready' ELSE 'pending' END AS status FROM t LEFT JOIN m USING (track_id) LEFT JOIN i USING (analysis_id))
"""


def _links(spark, d):
    items = table(spark, d, "collection_items").where("track_id is not null").groupBy("track_id").agg(F.min(F.coalesce("artist", F.lit(""))).alias("analysis_id"))
    return analysis.links(table(spark, d, "catalog_tracks"), items, table(spark, d, "catalog_artists").select(F.col("name").alias("analysis_id")))


@query(f"{_LINKS} SELECT * FROM links")
def track_links(spark, d):
    return _links(spark, d)


@query(f"{_LINKS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ready') AS usable, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'missing') AS missing, count(DISTINCT analysis_id) FILTER (WHERE status = 'ready') AS usable_ids FROM links")
def link_counts(spark, d):
    return analysis.link_counts(_links(spark, d))


@query("SELECT count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_shared, coalesce(max(n), 0) AS largest FROM (SELECT artist_id, count(*) AS n FROM catalog_track_artists WHERE artist_id IS NOT NULL GROUP BY 1)")
def group_sizes(spark, d):
    return analysis.group_sizes(table(spark, d, "catalog_track_artists"), "artist_id")


@query("""SELECT catalog_instance_id, count(*) AS n_rows, count(DISTINCT track_id) AS n_tracks, count(DISTINCT track_id) FILTER (WHERE available) AS n_available, count(DISTINCT album_id) FILTER (WHERE duration_ms IS NOT NULL) AS n_albums, count(DISTINCT artist_display) FILTER (WHERE content_kind = 'music') AS n_artists FROM catalog_tracks GROUP BY 1""")
def distinct_counts(spark, d):
    known = lambda c, when: F.count_distinct(F.when(when, F.col(c)))
    return table(spark, d, "catalog_tracks").groupBy("catalog_instance_id").agg(F.count("*").alias("n_rows"), F.count_distinct("track_id").alias("n_tracks"), known("track_id", F.col("available")).alias("n_available"), known("album_id", F.col("duration_ms").isNotNull()).alias("n_albums"), known("artist_display", F.col("content_kind") == "music").alias("n_artists"))


@query("SELECT status, count(*) AS n, max(started_at) AS last_start, count(*) FILTER (WHERE completed_at IS NULL) AS n_open FROM catalog_scans GROUP BY 1")
def scan_states(spark, d):
    return table(spark, d, "catalog_scans").groupBy("status").agg(F.count("*").alias("n"), F.max("started_at").alias("last_start"), F.count_if(F.col("completed_at").isNull()).alias("n_open"))


@query("SELECT principal, collection_id, count(*) FILTER (WHERE kind = 'track') AS n_tracks, count(*) FILTER (WHERE kind = 'album') AS n_albums, max(updated_at) AS updated_at FROM (SELECT DISTINCT * FROM collection_items) GROUP BY 1, 2")
def collection_counts(spark, d):
    items = table(spark, d, "collection_items").select("principal", "collection_id", "id", "kind", "updated_at").distinct()
    return items.groupBy("principal", "collection_id").agg(F.count_if(F.col("kind") == "track").alias("n_tracks"), F.count_if(F.col("kind") == "album").alias("n_albums"), F.max("updated_at").alias("updated_at"))


@query("""WITH i AS (SELECT DISTINCT principal, collection_id, id, kind, updated_at, title FROM collection_items), c AS (SELECT DISTINCT principal, collection_id FROM i), r AS (SELECT * FROM i WHERE title IS NULL)
SELECT c.principal, c.collection_id, count(r.id) FILTER (WHERE kind = 'track') AS n_tracks, count(r.id) FILTER (WHERE kind = 'album') AS n_albums, max(updated_at) AS updated_at FROM c LEFT JOIN r ON c.principal = r.principal AND c.collection_id = r.collection_id GROUP BY 1, 2""")
def untitled_counts(spark, d):
    """All collections with their items that have no title; many have none."""
    items = table(spark, d, "collection_items")
    return browse.collection_counts(items, items.where("title is null"))


@query("SELECT principal, collection_id, kind, id, row_number() OVER (PARTITION BY principal, collection_id, kind ORDER BY position, id) - 1 AS place FROM (SELECT DISTINCT principal, collection_id, kind, id, position FROM collection_items)")
def renumbered_items(spark, d):
    rows = table(spark, d, "collection_items").select("principal", "collection_id", "kind", "id", "position").distinct()
    return with_group_position(rows, ["principal", "collection_id", "kind"], ["position", "id"], "place").withColumn("place", F.col("place") - 1).drop("position")


@query("""WITH o AS (SELECT DISTINCT track_id, title, artist, album FROM collection_items WHERE track_id IS NOT NULL), t AS (SELECT track_id, min(duration_ms) AS duration_ms, list_distinct(list(left(media_fp, 1)) FILTER (WHERE media_fp IS NOT NULL)) AS ids FROM catalog_tracks GROUP BY 1),
j AS (SELECT album AS analysis_id, regexp_replace(lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS ti, nullif(regexp_replace(lower(regexp_replace(coalesce(artist, ''), '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), '') AS ar, duration_ms, coalesce(ids, []) AS ids FROM o JOIN t USING (track_id) WHERE album IS NOT NULL),
w AS (SELECT analysis_id, max(n) AS most FROM (SELECT analysis_id, id, count(*) AS n FROM (SELECT analysis_id, unnest(ids) AS id FROM j) GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT analysis_id, count(*) AS n, coalesce(max(duration_ms) - min(duration_ms) > 3000, false) AS duration_conflict, count(DISTINCT ti) > 1 AND count(DISTINCT ar) > 1 AS text_conflict, count(*) FILTER (WHERE len(ids) > 0) AS known FROM j GROUP BY 1 HAVING count(*) > 1)
SELECT analysis_id, n, duration_conflict, text_conflict, known > 1 AND coalesce(most < known, false) AS recording_conflict FROM g LEFT JOIN w USING (analysis_id) WHERE duration_conflict OR text_conflict OR recording_conflict""")
def suspect_groups(spark, d):
    """Items that name one album, as if it named one recording; first digits of media fingerprints stand for ids of recordings."""
    items = table(spark, d, "collection_items").where("track_id is not null").select("track_id", "title", "artist", "album").distinct()
    known = table(spark, d, "catalog_tracks").groupBy("track_id").agg(F.min("duration_ms").alias("duration_ms"), F.collect_set(F.left("media_fp", F.lit(1))).alias("recording_ids"))
    return analysis.suspects(items.join(known, "track_id").select(F.col("album").alias("analysis_id"), "title", "artist", "duration_ms", "recording_ids"))


@query("""SELECT analysis_id, n, CASE WHEN n = 1 THEN 'complete' WHEN have < n THEN 'pending' WHEN differ THEN 'disagreement' ELSE 'complete' END AS verdict FROM
(SELECT track_id AS analysis_id, count(*) AS n, count(media_fp) AS have, count(DISTINCT media_fp) > 1 AS differ FROM (SELECT DISTINCT catalog_instance_id, published_generation, track_id, media_fp FROM catalog_tracks) GROUP BY 1)""")
def evidence(spark, d):
    rows = table(spark, d, "catalog_tracks").select("catalog_instance_id", "published_generation", "track_id", "media_fp").distinct()
    return analysis.evidence(rows.select(F.col("track_id").alias("analysis_id"), F.col("media_fp").alias("fingerprint")))


@query("""SELECT artist_id, batch, coalesce(sum(byte_length) OVER (PARTITION BY batch ORDER BY artist_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset, byte_length, dimensions FROM
(SELECT artist_id, (row_number() OVER (ORDER BY artist_id) - 1) // 250 AS batch, (4 * length(name))::BIGINT AS byte_length, length(name)::BIGINT AS dimensions FROM (SELECT artist_id, min(name) AS name FROM catalog_artists WHERE artist_id IS NOT NULL GROUP BY 1))""")
def batch_index(spark, d):
    rows = table(spark, d, "catalog_artists").where("artist_id is not null").groupBy("artist_id").agg(F.char_length(F.min("name")).cast("bigint").alias("dimensions"))
    return analysis.batch_index(rows, "artist_id")


@query("SELECT position_, artist_id FROM (SELECT artist_id, row_number() OVER (ORDER BY artist_id) AS position_ FROM (SELECT DISTINCT artist_id FROM catalog_artists))")
def global_positions(spark, d):
    return with_position(table(spark, d, "catalog_artists").select("artist_id").distinct(), ["artist_id"], "position_")


# ids


@query("""SELECT DISTINCT track_id, CASE WHEN regexp_full_match(track_id, '[0-9A-Za-z]{22}') THEN 'base62' WHEN regexp_full_match(track_id, '[0-9a-fA-F]{32}') THEN 'hex32' WHEN regexp_full_match(track_id, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') THEN 'uuid' ELSE 'unrecognized' END AS shape FROM catalog_tracks""")
def id_shapes(spark, d):
    rows = table(spark, d, "catalog_tracks").select("track_id").distinct()
    return rows.select("track_id", F.regexp_replace(identity.canonical_id(F.col("track_id"))["shape"], "base62_(128|overflow)", "base62").alias("shape"))


_DIGITS = f"'{identity.ALPHABET}'"
_NUMBER = lambda text, base: f"list_reduce(list_transform(string_split({text}, ''), lambda c: (strpos({_DIGITS}, c) - 1)::UHUGEINT), lambda a, b: a * {base} + b)"
_BASE62 = lambda n: " || ".join(f"substr({_DIGITS}, (({n}) // {62**k}::UHUGEINT % 62)::INT + 1, 1)" for k in range(21, -1, -1))
_PLACES = lambda text: f"list_transform(string_split({text}, ''), lambda c: strpos({_DIGITS}, c))"


def _canonical(source: str, column: str) -> str:
    """CTE v: `column` of a relation, its canonical value and its shape."""
    return f"""s AS (SELECT DISTINCT {column}, CASE WHEN NOT regexp_full_match({column}, '[0-9A-Za-z]{{22}}') THEN CASE WHEN regexp_full_match({column}, '[0-9a-fA-F]{{32}}') THEN 'hex32' WHEN regexp_full_match({column}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') THEN 'uuid' ELSE 'unrecognized' END
  WHEN {_PLACES(column)} <= {_PLACES("'7N42dgm5tFLK9N8MT7fHC7'")} THEN 'base62_128' ELSE 'base62_overflow' END AS shape FROM {source}),
n AS (SELECT *, CASE WHEN shape = 'base62_overflow' THEN {_NUMBER(f'md5({column})', 16)} WHEN shape IN ('hex32', 'uuid') THEN {_NUMBER(f"lower(replace({column}, '-', ''))", 16)} END AS n FROM s),
v AS (SELECT {column}, shape, CASE WHEN n IS NULL THEN {column} ELSE {_BASE62('n')} END AS value FROM n)"""


@query(f"WITH {_canonical('catalog_tracks', 'track_id')} SELECT track_id, value, shape <> 'unrecognized' AS recognized, value <> track_id AS changed, shape FROM v")
def canonical_ids(spark, d):
    rows = table(spark, d, "catalog_tracks").select("track_id").distinct()
    return rows.select("track_id", identity.canonical_id(F.col("track_id")).alias("c")).select("track_id", "c.*")


@query(f"""WITH {_canonical('catalog_scan_entities', 'entity_id')}, was AS (SELECT entity_type, entity_id, max(metadata_fp) AS fp FROM catalog_scan_entities GROUP BY 1, 2),
now_ AS (SELECT entity_type, CASE WHEN entity_type = 'library' THEN entity_id ELSE value END AS entity_id, max(fp) AS fp FROM was JOIN v USING (entity_id) GROUP BY 1, 2),
moves AS (SELECT entity_type, entity_id AS old_id, value AS entity_id FROM was JOIN v USING (entity_id) WHERE entity_type <> 'library' AND shape <> 'unrecognized' AND value <> entity_id),
claims AS (SELECT entity_type, entity_id, count(*) AS n, min(old_id) AS old_id FROM moves GROUP BY 1, 2), gone AS (SELECT entity_type, old_id AS entity_id, true AS moved FROM moves),
state AS (SELECT entity_type, entity_id, n, old_id, moved, w.entity_id IS NOT NULL AS before, x.entity_id IS NOT NULL AS after, w.fp IS NOT DISTINCT FROM x.fp AS same FROM was w FULL JOIN now_ x USING (entity_type, entity_id) LEFT JOIN claims USING (entity_type, entity_id) LEFT JOIN gone USING (entity_type, entity_id)),
plan AS (SELECT *, CASE WHEN n > 1 OR (n IS NOT NULL AND before) THEN 'conflict' WHEN n = 1 THEN 'rekey' WHEN before AND after AND same THEN 'unchanged' WHEN after THEN 'upsert' WHEN moved IS NULL THEN 'delete' END AS operation FROM state)
SELECT entity_type, entity_id, operation, CASE WHEN operation = 'rekey' THEN old_id END AS old_entity_id FROM plan WHERE operation IS NOT NULL""")
def rekey_plan(spark, d):
    """The plan for a catalogue whose ids all took their canonical form."""
    old = table(spark, d, "catalog_scan_entities").select("entity_type", "entity_id", "metadata_fp")
    form = identity.canonical_id(F.col("entity_id"))["value"]
    new = old.select("entity_type", F.when(F.col("entity_type") == "library", F.col("entity_id")).otherwise(form).alias("entity_id"), "metadata_fp")
    return identity.rekey_plan(old, new, ["metadata_fp"])


@query("SELECT DISTINCT t.track_id, coalesce(i.id, t.track_id) AS id FROM (SELECT DISTINCT track_id FROM catalog_tracks) t LEFT JOIN (SELECT track_id, min(id) AS id FROM collection_items WHERE track_id IS NOT NULL GROUP BY 1) i USING (track_id)")
def rekeyed_ids(spark, d):
    mapping = table(spark, d, "collection_items").where("track_id is not null").groupBy(F.col("track_id").alias("old_id")).agg(F.min("id").alias("new_id"))
    rows = table(spark, d, "catalog_tracks").select("track_id").distinct().withColumn("id", F.col("track_id"))
    return journal.rekeyed(rows, "id", mapping)
