"""Queries of the general data problems, over whole tables."""

from cadastra.operators import changefeed, references, snapshots
from cadastra.sources import table


def _catalogue(spark, d):
    return [table(spark, d, t) for t in ("catalog_artists", "catalog_albums", "catalog_tracks", "catalog_track_artists", "collection_items")]


def p1_found(spark, d):
    return references.dangling_references(*_catalogue(spark, d))


def p1_report(spark, d):
    return references.dangling_report(*_catalogue(spark, d))


def p2_found(spark, d):
    return snapshots.scan_changes(table(spark, d, "catalog_scans"), table(spark, d, "catalog_scan_entities"))


def p2_counts(spark, d):
    return snapshots.scan_change_counts(table(spark, d, "catalog_scans"), table(spark, d, "catalog_scan_entities"))


def p5_found(spark, d):
    return p5_state(spark, d).select("catalog_instance_id", "entity_type", "entity_id", "seq")


def p5_state(spark, d):
    return changefeed.current_entities(table(spark, d, "catalog_changes"), ["payload", "generation", "change_reason"])


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_counts, p5_found, p5_state)}

_P1 = """
refs AS (
  SELECT 'catalog_track_artists' AS src_table, 'artist_id' AS src_field, CAST(c.published_generation AS VARCHAR) AS period,
    concat_ws('/', c.catalog_instance_id, c.published_generation, c.track_id, c.position, c.role) AS row_key,
    EXISTS (SELECT 1 FROM catalog_artists a WHERE a.catalog_instance_id = c.catalog_instance_id AND a.published_generation = c.published_generation AND a.artist_id = c.artist_id AND a.available) AS found
  FROM catalog_track_artists c WHERE c.artist_id IS NOT NULL
  UNION ALL
  SELECT 'collection_items', 'track_id', strftime(i.added_at, '%Y-%m'), i.id,
    EXISTS (SELECT 1 FROM now_tracks t WHERE t.track_id = i.track_id AND t.first_seen_at <= i.added_at)
  FROM collection_items i WHERE i.track_id IS NOT NULL
  UNION ALL
  SELECT 'collection_items', 'provider_album_id', strftime(i.added_at, '%Y-%m'), i.id,
    EXISTS (SELECT 1 FROM now_albums t WHERE t.album_id = i.provider_album_id AND t.first_seen_at <= i.added_at)
  FROM collection_items i WHERE i.provider_album_id IS NOT NULL
)"""
_NOW = "\n".join(
    f"now_{t} AS (SELECT {k}, min(first_seen_at) AS first_seen_at FROM catalog_{t} JOIN (SELECT catalog_instance_id, max(published_generation) AS published_generation FROM catalog_{t} GROUP BY 1) USING (catalog_instance_id, published_generation) WHERE available GROUP BY 1),"
    for t, k in (("tracks", "track_id"), ("albums", "album_id"))
)
_P2 = """
WITH placed AS (
  SELECT scan_id, catalog_instance_id, row_number() OVER (PARTITION BY catalog_instance_id ORDER BY started_at, scan_id) AS place
  FROM catalog_scans WHERE status = 'complete'
), rows_ AS (
  SELECT DISTINCT p.catalog_instance_id, p.place, e.entity_type, e.entity_id, e.metadata_fp, e.media_fp, e.artwork_fp FROM catalog_scan_entities e JOIN placed p USING (scan_id)
), diff AS (
  SELECT coalesce(n.catalog_instance_id, o.catalog_instance_id) AS inst, coalesce(n.place, o.place + 1) AS place, coalesce(n.entity_type, o.entity_type) AS entity_type, coalesce(n.entity_id, o.entity_id) AS entity_id,
    CASE WHEN o.entity_id IS NULL THEN 'added' WHEN n.entity_id IS NULL THEN 'removed'
      WHEN o.metadata_fp IS DISTINCT FROM n.metadata_fp OR o.media_fp IS DISTINCT FROM n.media_fp OR o.artwork_fp IS DISTINCT FROM n.artwork_fp THEN 'changed' END AS change_kind
  FROM rows_ n FULL OUTER JOIN rows_ o ON n.catalog_instance_id = o.catalog_instance_id AND n.place = o.place + 1 AND n.entity_type = o.entity_type AND n.entity_id = o.entity_id
), found AS (
  SELECT p.scan_id, d.entity_type, d.entity_id, d.change_kind FROM diff d JOIN placed p ON p.catalog_instance_id = d.inst AND p.place = d.place
  WHERE d.place > 1 AND d.change_kind IS NOT NULL
)"""
#: Applied in order: a change counts if nothing later removes its entity; the last of those stands.
_P5 = """
WITH cur AS (
  SELECT DISTINCT c.catalog_instance_id, c.entity_type, c.entity_id, c.old_entity_id, c.operation, c.seq, c.payload, c.generation, c.change_reason
  FROM catalog_changes c JOIN (SELECT catalog_instance_id, arg_max(epoch, generation) AS epoch FROM catalog_changes GROUP BY 1) e USING (catalog_instance_id, epoch)
), events AS (
  SELECT catalog_instance_id, entity_type, entity_id, seq, TRUE AS made, payload, generation, change_reason FROM cur WHERE operation <> 'delete'
  UNION ALL SELECT catalog_instance_id, entity_type, CASE WHEN operation = 'delete' THEN entity_id ELSE old_entity_id END, seq, FALSE, NULL, NULL, NULL FROM cur WHERE operation <> 'upsert'
), last_ AS (
  SELECT *, row_number() OVER (PARTITION BY catalog_instance_id, entity_type, entity_id ORDER BY seq DESC, made DESC) AS n FROM events
)
SELECT catalog_instance_id, entity_type, entity_id, seq{more} FROM last_ WHERE n = 1 AND made
"""
ORACLE = {
    "p1_found": f"WITH {_NOW} {_P1} SELECT DISTINCT src_table, src_field, period, row_key FROM refs WHERE NOT found",
    "p1_report": f"WITH {_NOW} {_P1} SELECT src_table, src_field, period, count(DISTINCT row_key) AS n_rows, count(DISTINCT row_key) FILTER (WHERE NOT found) AS n_orphans FROM refs GROUP BY 1, 2, 3",
    "p2_found": f"{_P2} SELECT * FROM found",
    "p2_counts": f"{_P2} SELECT scan_id, entity_type, change_kind, count(*) AS n FROM found GROUP BY 1, 2, 3",
    "p5_found": _P5.format(more=""),
    "p5_state": _P5.format(more=", payload, generation, change_reason"),
}
