"""Queries of the vector, loudness and streaming operators."""

import uuid

from pyspark.sql import functions as F

from cadastra.functions import numbers, vectors
from cadastra.functions.text import edition_text
from cadastra.operators import loudness, similarity
from cadastra.operators.ranks import with_group_position
from cadastra.session import shared_folder
from cadastra.sources import table
from cadastra.streaming import journal as streams

QUERIES, ORACLE = {}, {}
DIMENSION = 64


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("SELECT label, list(round(m, 4) ORDER BY i) AS mean FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1")
def vector_means(spark, d):
    mean = table(spark, d, "embeddings").groupBy("label").agg(vectors.vector_mean(F.col("embedding"), DIMENSION).alias("m"))
    return mean.select("label", F.transform("m", lambda x: F.round(x.cast("double"), 4)).alias("mean"))


_PAIR = "round(round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), 6)"


@query(f"SELECT a.vec_id AS query, b.vec_id AS id, {_PAIR} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), b.vec_id) <= 12")
def nearest_vectors(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = similarity.nearest(rows.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding"), rows, similarity.DEFAULT.top)
    return found.select("query", "id", F.round("distance", 6).alias("distance"))


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1")
def range_stats(spark, d):
    stats = numbers.range_stats(F.col("value"))
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), *stats)
    return rows.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "q1", "q3")])


_ENDS = "CASE WHEN q1 = 0 AND q3 = 0 THEN lo ELSE q1 END / 1000 AS a, CASE WHEN q1 = 0 AND q3 = 0 THEN hi ELSE q3 END / 1000 AS b"
_RANGE = "min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3"


@query(f"""WITH x AS (SELECT t, {_ENDS} FROM (SELECT event_type AS t, {_RANGE} FROM events GROUP BY 1)), y AS (SELECT {_ENDS} FROM (SELECT {_RANGE} FROM events))
SELECT x.t AS event_type, round(CASE WHEN x.a = x.b AND y.a = y.b THEN least(1, abs(x.a - y.a)) WHEN greatest(x.a, y.a) > least(x.b, y.b) THEN least(1, greatest(x.a, y.a) - least(x.b, y.b)) WHEN greatest(x.b, y.b) <= least(x.a, y.a) THEN 0 ELSE greatest(0, least(1, 1 - (least(x.b, y.b) - greatest(x.a, y.a)) / (greatest(x.b, y.b) - least(x.a, y.a)))) END, 6) AS distance FROM x, y""")
def interval_distances(spark, d):
    """How far the values of each event type are from those of all events."""
    events = table(spark, d, "events")

    def ends(stats):
        low, high = numbers.interval(*[F.col(c) / 1000 for c in ("low", "high", "q1", "q3")])
        return stats.withColumns({"a": low, "b": high})

    every = ends(events.agg(*numbers.range_stats(F.col("value"))))
    each = ends(events.groupBy("event_type").agg(*numbers.range_stats(F.col("value")))).select("event_type", "a", "b", every.select(F.struct("a", "b")).scalar().alias("y"))
    return each.select("event_type", F.round(numbers.interval_distance((F.col("a"), F.col("b")), (F.col("y.a"), F.col("y.b"))), 6).alias("distance"))


def _tracks(spark, d):
    """The vectors as tracks: three albums a label, energies and moods from the vectors, years by album."""
    e = table(spark, d, "embeddings")
    part = F.col("vec_id") % 3
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(
        F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("order"), "embedding", F.abs(at(0)).alias("energy"), F.array(*[F.abs(at(i)) for i in range(1, 7)]).alias("mood"),
        F.concat(F.lit("Album "), part.cast("string")).alias("album"), (F.lit(2000) + part).cast("int").alias("year"), F.concat(F.lit("artist-"), F.col("label").cast("string")).alias("artist"),
    )


@query()
def similar_albums(spark, d):
    tracks = _tracks(spark, d).withColumn("entity", F.concat_ws("/", "artist", "album"))
    names = tracks.select("entity", "album", "artist", edition_text(F.col("album")).alias("edition"), edition_text(F.col("artist")).alias("artist_edition")).distinct()
    return similarity.similar_albums(tracks, names, DIMENSION)


@query()
def similar_artists(spark, d):
    tracks = _tracks(spark, d).withColumn("entity", F.col("artist"))
    return similarity.similar_artists(tracks, tracks.select("entity", "artist").distinct(), DIMENSION)


@query("""SELECT artist_id, album_id, n_tracks, rank FROM (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY turn, n_tracks DESC, album_id) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY artist_id, kind ORDER BY n_tracks DESC, album_id) AS turn FROM (SELECT c.artist_id, t.album_id, min(t.content_kind || coalesce(t.release_type, '')) AS kind, count(*) AS n_tracks FROM catalog_track_artists c JOIN (SELECT DISTINCT catalog_instance_id, published_generation, track_id, album_id, content_kind, release_type FROM catalog_tracks WHERE album_id IS NOT NULL) t USING (catalog_instance_id, published_generation, track_id) WHERE c.artist_id IS NOT NULL GROUP BY 1, 2)) WHERE turn <= 3) WHERE rank <= 12""")
def diverse_albums(spark, d):
    """An artist's albums with the most credits, mixed by kind."""
    scope = ["catalog_instance_id", "published_generation", "track_id"]
    tracks = table(spark, d, "catalog_tracks").where("album_id is not null").select(*scope, "album_id", "content_kind", "release_type").distinct()
    credits = table(spark, d, "catalog_track_artists").where("artist_id is not null").select(*scope, "artist_id")
    rows = credits.join(tracks, scope).groupBy("artist_id", "album_id").agg(F.min(F.concat("content_kind", F.coalesce("release_type", F.lit("")))).alias("kind"), F.count("*").alias("n_tracks"))
    return similarity.diverse_top(rows, "artist_id", [F.desc("n_tracks"), F.asc("album_id")], "kind").select("artist_id", "album_id", "n_tracks", "rank")


# loudness

_WINDOWS = "w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / 5 - 80 AS x FROM events)"


def _windows(spark, d):
    """Each user's events as a series of loudness windows."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 5 - 80).alias("x"))
    return with_group_position(rows, ["user_id"], ["ts", "event_id"], "i").withColumn("i", F.col("i") - 1)


@query("SELECT user_id, round(10 * log10(avg(pow(10, (value / 5 - 80 + 0.691) / 10)) FILTER (WHERE value / 5 - 80 > -70)) - 0.691, 6) AS lufs FROM events GROUP BY 1")
def integrated_loudness(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(loudness.integrated_loudness(F.col("value") / 5 - 80), 6).alias("lufs"))


@query(f"WITH {_WINDOWS}, n AS (SELECT user_id, max(i) AS last_ FROM w GROUP BY 1), t AS (SELECT unnest([{', '.join(map(str, loudness.THRESHOLDS))}]) AS threshold) SELECT user_id, threshold, least(min(i), 65535) AS first_index, least(max(last_) - max(i), 65535) AS last_distance FROM w JOIN n USING (user_id), t WHERE x + 30 >= threshold GROUP BY 1, 2")
def ramp_entries(spark, d):
    return loudness.ramp_entries(_windows(spark, d).withColumn("relative", F.col("x") + 30), "user_id", "i", "relative")


# streaming


def _root(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("""WITH c AS (SELECT DISTINCT catalog_instance_id, epoch, seq, entity_type, entity_id, operation, old_entity_id FROM catalog_changes),
e AS (SELECT catalog_instance_id, epoch, entity_type, entity_id, seq, true AS made FROM c WHERE operation <> 'delete' UNION ALL SELECT catalog_instance_id, epoch, entity_type, CASE operation WHEN 'delete' THEN entity_id ELSE old_entity_id END, seq, false FROM c WHERE operation <> 'upsert')
SELECT catalog_instance_id, epoch, entity_type, entity_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY catalog_instance_id, epoch, entity_type, entity_id ORDER BY seq DESC, made DESC) AS n FROM e) WHERE n = 1 AND made""")
def streamed_state(spark, d):
    """The state of every epoch, folded from the journal as a stream."""
    scope = ["catalog_instance_id", "epoch"]
    state = streams.JournalFold(_root(spark), scope, ["payload"]).run(streams.read_stream(spark, d, "catalog_changes"))
    return streams.living(state).select(*scope, "entity_type", "entity_id", F.col("made.seq").alias("seq"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY 1, 2")
def streamed_days(spark, d):
    """Events per closed day and type."""
    return streams.closed_windows(streams.read_stream(spark, d, "events"), _root(spark), "ts", "1 day", "6 hours", "event_type")
