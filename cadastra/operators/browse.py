"""Library browsing: the track view, pages of albums, tracks and artists, statistics and search."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.text import matches_all, search_text, search_tokens
from cadastra.session import salted_join

#: A query of fewer characters finds nothing.
LEAST_QUERY = 3


def track_view(tracks: DataFrame, albums: DataFrame) -> DataFrame:
    """Available tracks of each instance's latest generation with their album, if that is available.

    Repeated rows count once. The album's name is NULL where the album is gone, and the track stays: its availability is a
    condition of the join. Instances are few and uneven and an album may be large: both are joined with salts.
    """
    scope = ["catalog_instance_id", "published_generation"]
    latest = tracks.groupBy("catalog_instance_id").agg(F.max("published_generation").alias("published_generation"))
    now = salted_join(tracks.where("available").select(*scope, "track_id", "album_id", "title", "artist_display", "album_artist_display", "disc_number", "track_number", "duration_ms", "cover_art_id"), latest, scope, [F.col("track_id")]).distinct()
    named = albums.where("available").groupBy(*scope, "album_id").agg(F.min("name").alias("album"), F.min("album_artist_display").alias("__album_artist"))
    view = salted_join(now, named, [*scope, "album_id"], [F.col("track_id")], "left_outer")
    return view.select("catalog_instance_id", "track_id", "album_id", "title", F.col("artist_display").alias("artist"), F.coalesce("album_artist_display", "__album_artist", "artist_display").alias("album_artist"), "album", "disc_number", "track_number", "duration_ms", "cover_art_id")


def found(view: DataFrame, query: str | None, columns: tuple[str, ...] = ("title", "artist", "album", "album_artist")) -> DataFrame:
    """Rows in which every token of the query occurs; all rows for no query, none for one that is too short."""
    if query is None or not query.strip():
        return view
    if len(query.strip()) < LEAST_QUERY:
        return view.where(F.lit(False))
    return view.where(matches_all(search_text(*columns), search_tokens(query)))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in `order`, each with the total before the limit (as `total`); an empty page has no rows.

    The total is a scalar subquery, counted by partial aggregation, so no window gathers all rows; the page is the head of
    a top-k.
    """
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).select("*", total.scalar().alias("total"))


def albums_of(view: DataFrame) -> DataFrame:
    """Albums by name and album artist: album, album_artist, first_track, n_tracks, duration_ms."""
    return view.where("album is not null").groupBy("album", "album_artist").agg(F.min("track_id").alias("first_track"), F.count("*").alias("n_tracks"), F.sum("duration_ms").alias("duration_ms"))


def artists_of(view: DataFrame) -> DataFrame:
    """Artists: artist, n_tracks, n_albums (distinct non-empty names)."""
    return view.where("artist is not null").groupBy("artist").agg(F.count("*").alias("n_tracks"), F.count_distinct(F.nullif(F.col("album"), F.lit(""))).alias("n_albums"))


def browse_albums(view: DataFrame, limit: int = 36, offset: int = 0, query: str | None = None) -> DataFrame:
    order = [F.lower("album").asc_nulls_last(), F.lower("album_artist").asc_nulls_last(), F.asc("album"), F.asc_nulls_last("album_artist")]
    return page(albums_of(found(view, query)), order, limit, offset)


def browse_tracks(view: DataFrame, limit: int = 50, offset: int = 0, query: str | None = None) -> DataFrame:
    order = [F.lower("title").asc_nulls_last(), F.asc("catalog_instance_id"), F.asc("track_id")]
    return page(found(view, query).select("catalog_instance_id", "track_id", "title", "artist", "album"), order, limit, offset)


def browse_artists(view: DataFrame, limit: int = 50, offset: int = 0, query: str | None = None) -> DataFrame:
    return page(artists_of(found(view, query)), [F.lower("artist").asc_nulls_last(), F.asc("artist")], limit, offset)


def browse_all(view: DataFrame, query: str, each: int = 12) -> dict[str, DataFrame]:
    """The first few albums, tracks and artists that a query finds."""
    return {"albums": browse_albums(view, each, 0, query), "tracks": browse_tracks(view, each, 0, query), "artists": browse_artists(view, each, 0, query)}


def library_stats(view: DataFrame) -> DataFrame:
    """One row: tracks, distinct albums (name and album artist), distinct artists."""
    album = F.when(F.col("album").isNotNull(), F.struct("album", F.coalesce("album_artist", F.lit(""))))
    return view.agg(F.count("*").alias("n_tracks"), F.count_distinct(album).alias("n_albums"), F.count_distinct("artist").alias("n_artists"))


def any_like(rows: DataFrame, text: str, columns: list[str], limit: int) -> DataFrame:
    """Rows in which one of the columns contains the text, without regard to case; the first `limit` by all columns."""
    if len(text.strip()) < 2:
        return rows.where(F.lit(False))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return rows.where(hit).orderBy(*[F.asc_nulls_last(c) for c in rows.columns]).limit(limit)


def album_tracks(view: DataFrame, album: str, album_artist: str) -> DataFrame:
    """Tracks of an album by disc (none is 1), number (none is last) and id."""
    own = view.where((F.col("album") == album) & (F.col("album_artist") == album_artist))
    return own.select("track_id", "title", "disc_number", "track_number", "duration_ms").orderBy(F.coalesce(F.nullif(F.col("disc_number"), F.lit(0)), F.lit(1)), F.coalesce("track_number", F.lit(1_000_000)), "track_id")


def collection_counts(collections: DataFrame, items: DataFrame) -> DataFrame:
    """principal, collection_id, n_tracks, n_albums, updated_at of every collection, also of those without items.

    Repeated items (one id) count once; items are counted before they meet their collections, so a collection may be of any size.
    """
    keys = ["principal", "collection_id"]
    kinds = [F.count_if(F.col("kind") == kind).alias(name) for kind, name in (("track", "n_tracks"), ("album", "n_albums"))]
    counted = items.select(*keys, "id", "kind", "updated_at").distinct().groupBy(*keys).agg(*kinds, F.max("updated_at").alias("updated_at"))
    both = collections.select(*keys).distinct().join(counted, keys, "left")
    return both.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tracks", "n_albums")], "updated_at")
