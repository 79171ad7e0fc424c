"""Queries of the text problems, over whole tables and whole texts."""

from cadastra.llm import copies, glyphs, packing, tokens, truncation
from cadastra.sources import table

_ITEM = ("id", ["principal", "kind"], ["title", "artist", "album"], ["album_key"])


def p3_found(spark, d):
    return copies.formatting_copies(table(spark, d, "collection_items"), *_ITEM)


def p3_records(spark, d):
    return copies.collapsed(table(spark, d, "collection_items"), *_ITEM)


def p4_found(spark, d):
    return p4_forms(spark, d).where("cause = 'characters'").select("src_table", "src_field", "row_key").distinct()


def p4_forms(spark, d):
    return glyphs.affected_rows(glyphs.field_values(table(spark, d, "collection_items"), table(spark, d, "catalog_track_artists")))


def p6_ids(spark, d):
    return tokens.encode_corpus(table(spark, d, "documents"))


def p6_decoded(spark, d):
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, d, "documents")))


def p7_containers(spark, d):
    return packing.pack(packing.token_lengths(table(spark, d, "documents")), "doc_id", "n_tokens")


def p7_report(spark, d):
    return packing.fill_report(p7_containers(spark, d))


def p8_found(spark, d):
    return truncation.cut_texts(table(spark, d, "documents")).select("doc_id").distinct()


def p8_report(spark, d):
    return truncation.cut_report(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_records, p4_found, p4_forms, p6_ids, p6_decoded, p7_containers, p7_report, p8_found, p8_report)}

_P3 = r"""
WITH items AS (SELECT DISTINCT id, principal, kind, title, artist, album, album_key FROM collection_items),
sides AS (
  SELECT id, principal, kind, list_sort(list_distinct(list_filter(list_transform(
    [title, artist, album] || coalesce(string_split(album_key, '::'), []), lambda x: regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}]', '', 'g')), lambda x: x IS NOT NULL AND x <> ''))) AS content
  FROM items
), sets AS (SELECT principal, kind, content, min(id) AS keep_id, count(DISTINCT id) AS n_copies FROM sides GROUP BY ALL)
"""
ORACLE = {
    "p3_found": _P3 + "SELECT DISTINCT s.keep_id, i.id AS copy_id FROM sets s JOIN sides i ON s.principal IS NOT DISTINCT FROM i.principal AND s.kind IS NOT DISTINCT FROM i.kind AND s.content = i.content WHERE i.id <> s.keep_id",
    "p3_records": _P3 + "SELECT principal, kind, keep_id, n_copies FROM sets",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
