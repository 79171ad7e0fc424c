import struct

import pytest
from pyspark.sql import functions as F

from cadastra.functions import numbers, text, vectors
from cadastra.operators import analysis, browse
from cadastra.plans.catalogue import QUERIES


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("Album (Deluxe Edition)", "album"), ("Album (Japanese) (2011 Remastered)", "album"), ("Album (Live)", "album (live)"), (" A ", "a"), (None, ""), ("(Expanded)", "")],
)
def test_edition_text(spark, given, want):
    assert one(spark, "v string", (given,), text.edition_text(F.col("v"))) == want


def test_texts(spark):
    v = F.col("v")
    assert one(spark, "v string", ("  é\n",), text.clean(v)) == "é" and one(spark, "v string", (" ",), text.clean(v)) is None
    assert one(spark, "v array<string>", ([" a", "b", None, "a", ""],), text.display_list(v)) == "a, b"
    assert one(spark, "v string", ("Æther — 2 Go!",), text.normal_key(v)) == "ther 2 go"
    assert one(spark, "v string", ("b, a ,,b,c",), text.id_list(v)) == ["b", "a", "c"]
    assert one(spark, "v binary", (bytes(range(250)) + b"\xfb\xff",), text.base64url(v)).count("=") == 0
    assert one(spark, "v string", ("Audiobook",), text.content_kind(v)) == "music" and one(spark, "v string", ("Music Video",), text.content_kind(v)) == "video"


def test_numbers(spark):
    v = F.col("v")
    assert one(spark, "v string", ("12.7",), numbers.whole(v)) == 12 and one(spark, "v string", ("x",), numbers.whole(v)) is None and one(spark, "v string", ("Infinity",), numbers.whole(v)) is None
    assert one(spark, "v string", ("happy:0.8, sad:x,party:NaN,happy:0.5,bad",), numbers.features(v)) == {"happy": 0.5}
    assert one(spark, "v string", ("danceable:0.7,sad:0.1",), numbers.mood_vector(v, F.lit("sad:0.9"))) == [0.7, 0.0, 0.0, 0.0, 0.0, 0.9]
    assert one(spark, "v double", (0.08,), numbers.energy(v)) == pytest.approx(0.5)
    none = F.lit(None).cast("bigint")
    assert one(spark, "v double", (0.0025,), numbers.duration_ms(none, none, v)) == 2 and one(spark, "v double", (float("nan"),), numbers.duration_ms(none, none, v)) is None


def test_vectors(spark):
    blob = struct.pack("<3f", 1, 2, 3)
    for n, want in ((3, [1.0, 2.0, 3.0]), (2, None), (0, None)):
        assert one(spark, "v binary, n int", (blob, n), vectors.from_f32le(F.col("v"), F.col("n"))) == want
    assert bytes(one(spark, "v array<float>", ([1.0, 2.0, 3.0],), vectors.to_f32le(F.col("v")))) == blob
    d = lambda a, b: one(spark, "a array<float>, b array<float>", (a, b), vectors.cosine_distance(F.col("a"), F.col("b")))
    assert d([1.0, 0.0], [0.0, 2.0]) == 1 and d([1.0], [-3.0]) == 2 and d([0.0], [1.0]) == 1 and d(None, [1.0]) == 1 and d([1.0], [1.0, 2.0]) == 1 and d([2.0, 2.0], [1.0, 1.0]) == pytest.approx(0)


def test_suspect_groups_take_the_tolerance_of_one_recording(spark, tmp_path):
    items = [("a", "Song", "One", "near"), ("b", "Song", "One", "near"), ("c", "Song", "One", "far"), ("d", "Song", "One", "far")]
    spark.createDataFrame(items, "track_id string, title string, artist string, album string").write.parquet(str(tmp_path / "collection_items.parquet"))
    spark.createDataFrame([("a", 100_000, None), ("b", 103_000, None), ("c", 100_000, "x1"), ("d", 103_001, "x2")], "track_id string, duration_ms bigint, media_fp string").write.parquet(str(tmp_path / "catalog_tracks.parquet"))
    assert [r["analysis_id"] for r in QUERIES["suspect_groups"](spark, str(tmp_path)).collect()] == ["far"]


def test_evidence_and_suspects(spark):
    rows = spark.createDataFrame([("one", None), ("same", "f"), ("same", "f"), ("none", "f"), ("none", ""), ("two", "f"), ("two", "g")], "analysis_id string, fingerprint string")
    verdicts = lambda **k: {r["analysis_id"]: r["verdict"] for r in analysis.evidence(rows, **k).collect()}
    assert verdicts() == {"one": "complete", "same": "complete", "none": "pending", "two": "disagreement"}
    assert set(verdicts(available=False).values()) == {"complete"} and verdicts(enabled=False)["two"] == "validation_unavailable"
    occ = spark.createDataFrame(
        [("d", "T", "A", 180_000, []), ("d", "T", "A", 240_000, []), ("t", "T", "A", 1, ["r"]), ("t", "U", "B", 2, ["r"]), ("r", "T", "A", 1, ["x", "y"]), ("r", "t ", "a", 1, ["z"]), ("ok", "T", "A", None, ["x"]), ("ok", " t", "A", 5, ["x", "q"]), ("ok", "T", "B", 6, [])],
        "analysis_id string, title string, artist string, duration_ms bigint, recording_ids array<string>",
    )
    got = {r["analysis_id"]: (r["duration_conflict"], r["text_conflict"], r["recording_conflict"]) for r in analysis.suspects(occ).collect()}
    assert got == {"d": (True, False, False), "t": (False, True, False), "r": (False, False, True)}


def test_batches(spark):
    data = analysis.pack_batch([("b", b"\0" * 8, 2, "c2"), ("a", b"\1" * 4, 1, "c1"), ("n", None, 1, "")], "musicnn", 3)
    size = struct.unpack("<I", data[:4])[0]
    assert b'"offset":4' in data[4 : 4 + size] and data[4 + size :] == b"\1" * 4 + b"\0" * 8
    with pytest.raises(ValueError):
        analysis.pack_batch([("a", b"\0", 1, "")], "musicnn", 1)
    with pytest.raises(ValueError):
        analysis.pack_batch([(f"{n:03}", b"\0" * 4, 1, "") for n in range(251)], "musicnn", 1)
    mixed = [(f"{n:03}", None if n % 4 == 0 and n < 280 else b"\1" * 4, 1, "") for n in range(320)]  # 70 without bytes, between the others
    data = analysis.pack_batch(mixed, "musicnn", 1)
    assert data.count(b'"analysis_id"') == 250 and data.endswith(b"\1" * 1000)
    sizes = spark.createDataFrame([(f"{n:04}", 1 + n % 3) for n in range(600)], "analysis_id string, dimensions bigint").repartition(3)
    index = analysis.batch_index(sizes).orderBy("analysis_id").collect()
    assert [r["batch"] for r in index] == [n // 250 for n in range(600)]
    assert all(r["offset"] == sum(x["byte_length"] for x in index[n // 250 * 250 : n]) for n, r in enumerate(index))
    one_, two = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in ("abc", "cabb"))
    assert analysis.sorted_scope_fingerprint(one_, "id", []).first() == analysis.sorted_scope_fingerprint(two, "id", []).first()


#: track, title, artist, album artist, album: three albums, one of them by an artist with an accent, and a single.
BROWSE = [
    ("k1", "Dripping Tap", "Lower Attic", "Lower Attic", "roof"), ("k2", "Second Ladder", "Lower Attic", "Lower Attic", "roof"), ("m1", "Ferry Timetable", "Lower Attic", "Lower Attic", "tide"),
    ("z1", "Ein Zug", "Zoë Kranich", "Zoë Kranich", "gleis"), ("z2", "Kein Zug", "Zoë Kranich", "Zoë Kranich", "gleis"), ("z3", "Ladder Song", "Zoë Kranich", "Zoë Kranich", "gleis"), ("s1", "Unshelved", "Nobody Much", None, None),
]


def test_browsing(spark):
    tracks = spark.createDataFrame([("i", 1, i, a, t, d, aa, 1, None, None, None, True) for i, t, d, aa, a in BROWSE] + [("i", 0, "old", "roof", "Old", "X", "X", 1, None, None, None, True), ("i", 1, "gone", "roof", "Gone", "X", "X", 1, None, None, None, False)], "catalog_instance_id string, published_generation bigint, track_id string, album_id string, title string, artist_display string, album_artist_display string, disc_number int, track_number int, duration_ms bigint, cover_art_id string, available boolean")
    albums = spark.createDataFrame([("i", 1, k, n, None, True) for k, n in (("roof", "On the Roof"), ("tide", "Tide Tables"), ("gleis", "Gleis Neun"))], "catalog_instance_id string, published_generation bigint, album_id string, name string, album_artist_display string, available boolean")
    view = browse.track_view(tracks, albums)
    assert tuple(browse.library_stats(view).first()) == (7, 3, 3)
    totals = lambda q: tuple(f(view, 50, 0, q).count() for f in (browse.browse_albums, browse.browse_tracks, browse.browse_artists))
    assert totals(None) == (3, 7, 3) and totals("kranich") == (1, 3, 1) and totals("zoe") == (1, 3, 1) and totals("ladder attic") == (1, 1, 1) and totals("qq") == (0, 0, 0)
    pages = [browse.browse_albums(view, 1, k).first() for k in range(3)]
    assert [p["total"] for p in pages] == [3] * 3 and [p["album"] for p in pages] == ["Gleis Neun", "On the Roof", "Tide Tables"]
    assert [r["track_id"] for r in browse.album_tracks(view, "On the Roof", "Lower Attic").collect()] == ["k1", "k2"]
    assert set(browse.browse_all(view, "tide")) == {"albums", "tracks", "artists"}
