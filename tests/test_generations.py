import pytest

from cadastra.operators import journal as j
from cadastra.operators import paging as p
from cadastra.operators.generations import GenerationStore, Moved
from cadastra.plans.catalogue import QUERIES

SCHEMA = "entity_type string, entity_id string, fp string, payload string"


def entities(spark, rows):
    return spark.createDataFrame([(t, i, f, "{}") for t, i, f in rows], SCHEMA)


def test_publish_read_and_prune(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path))
    first, counts = store.publish("i", entities(spark, [("track", "a", "1"), ("track", "b", "1"), ("album", "z", "1"), ("track", "b", "1")]), ["fp"])
    assert (first.generation, first.head_seq, counts) == (1, 3, {"track upsert": 2, "album upsert": 1})
    assert [(r["seq"], r["entity_id"]) for r in store.journal("i").orderBy("seq").collect()] == [(1, "z"), (2, "a"), (3, "b")]
    same, none = store.publish("i", entities(spark, [("track", "a", "1"), ("track", "b", "1"), ("album", "z", "1")]), ["fp"])
    assert same == first and not none
    second, counts = store.publish("i", entities(spark, [("track", "a", "2"), ("album", "z", "1"), ("track", "c", "1")]), ["fp"])
    assert (second.generation, second.head_seq) == (2, 6) and counts == {"track upsert": 2, "track delete": 1}
    assert store.read("entities", "i").count() == 3 and store.read("entities", "i", 1).count() == 3
    assert store.prune("i", {1}) == [] and store.prune("i") == [1]
    assert store.state("other").generation == 0


def test_a_second_writer_fails(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path))
    state, _ = store.publish("i", entities(spark, [("track", "a", "1")]), ["fp"])
    with pytest.raises(Moved):
        store._point(store.state("j").__class__("i"), state)
    assert store.state("i") == state


def test_retention():
    assert j.retention_floor(212_002, 42_199) == 127_604
    assert j.retention_floor(7620, 1324 + 581) == 3810
    assert j.retention_floor(500, 10) == 0


def test_the_journal_keeps_two_events_for_every_entity(spark, tmp_path):
    # 800 entities: 400 ids, each of an album and of a track
    rows = [("large", "e", 1, s, ("album", "track")[s % 2], str(s // 2 % 400)) for s in range(1, 1701)] + [("small", "e", 1, s, "track", str(s % 9)) for s in range(1, 1701)]
    spark.createDataFrame(rows, "catalog_instance_id string, epoch string, generation bigint, seq bigint, entity_type string, entity_id string").write.parquet(str(tmp_path / "catalog_changes.parquet"))
    kept = QUERIES["journal_compacted"](spark, str(tmp_path)).collect()
    assert sorted(r["seq"] for r in kept if r["catalog_instance_id"] == "large") == list(range(101, 1701))
    assert sorted(r["seq"] for r in kept if r["catalog_instance_id"] == "small") == list(range(701, 1701))


def test_diff_counts_repeats_once_and_nulls_are_equal(spark):
    old = spark.createDataFrame([("a", None), ("a", None), ("b", "1"), ("c", "1")], "k string, f string")
    new = spark.createDataFrame([("a", None), ("b", None), ("d", "1"), ("d", "1")], "k string, f string")
    assert sorted(tuple(r) for r in j.generation_diff(old, new, ["k"], ["f"]).collect()) == [("b", "upsert", False), ("c", "delete", False), ("d", "upsert", True)]


def test_pages_and_cursors(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(5)], "t string, i int")
    seen, token = [], None
    while True:
        found, token = p.snapshot_page(rows, ["t", "i"], token, b"key", 3)
        seen += [tuple(r) for r in found]
        if token is None:
            break
    assert seen == [("a", i) for i in range(5)] + [("b", i) for i in range(5)]
    with pytest.raises(ValueError):
        p.verify(p.sign({"after": 1}, b"key"), b"other")
    text = p.cursor("i", "e", 5)
    assert "=" not in text and p.read_cursor(text, "i", "e", 0, 9) == 5
    for args, error in ((("x", "e", 0, 9), ValueError), (("i", "f", 0, 9), p.BootstrapRequired), (("i", "e", 6, 9), p.BootstrapRequired), (("i", "e", 0, 4), ValueError)):
        with pytest.raises(error):
            p.read_cursor(text, *args)
    with pytest.raises(ValueError):
        p.read_cursor("!!", "i", "e", 0, 9)
    journal = spark.createDataFrame([(s, "x") for s in (3, 1, 2, 2, 7)], "seq bigint, entity_id string")
    found, after, more = p.changes_after(journal, p.cursor("i", "e", 1), "i", "e", 0, 7, 2)
    assert [r["seq"] for r in found] == [2, 3] and more and p.read_cursor(after, "i", "e", 0, 7) == 3


def test_nearest_around(spark):
    events = spark.createDataFrame([("k", 10), ("k", 20), ("m", 5)], "key string, at int")
    marks = spark.createDataFrame([("k", 10), ("k", 15), ("k", 25), ("n", 1)], "key string, at int")
    assert sorted((r["key"], r["at"], r["before"], r["after"]) for r in j.nearest_around(events, marks, "key").collect()) == [("k", 10, 10, 10), ("k", 15, 10, 20), ("k", 25, 20, None), ("n", 1, None, None)]
