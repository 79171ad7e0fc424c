import datetime as dt
import random

from pyspark.sql import functions as F

from cadastra.operators import references as r

T = lambda day: dt.datetime(2024, 1, day)
REFS = "key string, at timestamp_ntz, row string, since int"
PARENTS = "key string, since timestamp_ntz, row int, n_refs int"


def brute(refs, parents):
    since = {}
    for key, at, *_ in parents:
        if key is not None and at is not None:
            since[key] = min(since.get(key, at), at)
    return sorted(row for key, at, row, _ in refs if key is not None and (key not in since or at is None or since[key] > at))


def found(spark, refs, parents, **more):
    a, b = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    return sorted(x["row"] for x in r.orphan_rows(a, b.select("key", "since"), ["key"], [F.col("row")], **more).collect())


def test_missing_later_null_and_clashing_columns(spark):
    refs = [("a", T(5), "1", 0), ("a", T(1), "2", 0), ("b", T(5), "3", 0), (None, T(5), "4", 0), ("c", None, "5", 0), ("", T(9), "6", 0), ("A", T(9), "7", 0), ("a", T(3), "8", 0), ("a", T(3), "8", 0), ("x" * 100_000, T(2), "9", 0)]
    parents = [("a", T(3), 1, 1), ("a", T(4), 1, 1), ("b", None, 1, 1), ("c", T(1), 1, 1), (None, T(1), 1, 1), ("x" * 100_000, T(1), 1, 1)]
    assert found(spark, refs, parents) == brute(refs, parents) == ["2", "3", "5", "6", "7"]


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    refs = [(rng.choice("abcdefghijklmnop") * rng.randint(0, 3), T(rng.randint(1, 20)), str(i), 0) for i in range(600)] + [("hot", T(1 + i % 20), f"h{i}", 0) for i in range(300)]
    parents = [(rng.choice("abcdefgh") * rng.randint(0, 3), T(rng.randint(1, 20)), 0, 0) for _ in range(30)] + [("hot", T(10), 0, 0)]
    assert found(spark, refs, parents) == brute(refs, parents)


def test_keys_and_runs_for_any_number_of_buckets(spark):
    refs = spark.createDataFrame([(i % 50, T(2)) for i in range(200)], "key int, at timestamp_ntz")
    parents = spark.createDataFrame([(i, T(1)) for i in range(100) if i % 7], "key int, since timestamp_ntz")
    for buckets in (1, 3, 64):
        rows = r.orphan_keys(refs, parents, ["key"], buckets).collect()
        assert sorted((x["key"], x["n_refs"]) for x in rows) == [(k, 4) for k in range(0, 50, 7)]


def test_empty_tables(spark):
    refs, parents = [("a", T(1), "1", 0)], [("a", T(1), 0, 0)]
    assert found(spark, [], parents) == found(spark, [], []) == []
    assert found(spark, refs, []) == ["1"]


def test_deleted_parents_stay_in_the_dictionary_but_not_in_runs(spark):
    rng = random.Random(5)
    parents = [(f"k{i:03}", T(rng.randint(1, 20)), 0, 0) for i in range(200)]
    gone = {f"k{i:03}" for i in range(0, 200, 3)}
    refs = [(f"k{rng.randrange(220):03}", T(rng.randint(1, 20)), str(i), 0) for i in range(800)]
    want = brute(refs, [p for p in parents if p[0] not in gone])
    a = spark.createDataFrame(refs, REFS)
    b = spark.createDataFrame(parents, PARENTS).select("key", F.when(~F.col("key").isin(*gone), F.col("since")).alias("since"), F.col("since").alias("seen"))
    assert sorted(x["row"] for x in r.orphan_rows(a, b, ["key"], [F.col("row")]).collect()) == want
    assert r.judged_rows(a, b, ["key"], [F.col("row")]).count() == len(refs)


def test_credits_without_scope_and_items_of_both_fields(spark):
    empty = lambda t: spark.createDataFrame([], t)
    credits = spark.createDataFrame([(None, 1, "t", 0, "x", "a"), ("i", 1, "t", 0, "x", "a"), ("i", 2, "t", 0, "x", "a"), ("i", 1, "t", 1, None, "a")], "catalog_instance_id string, published_generation bigint, track_id string, position int, artist_id string, role string")
    artists = spark.createDataFrame([("i", 1, "x", True), ("i", 2, "x", False)], "catalog_instance_id string, published_generation bigint, artist_id string, available boolean")
    shape = "catalog_instance_id string, published_generation bigint, {} string, available boolean, first_seen_at timestamp_ntz"
    tracks = spark.createDataFrame([("i", 1, "p", True, T(2)), ("i", 2, "q", True, T(2)), ("j", 1, "p", True, T(4))], shape.format("track_id"))
    items = spark.createDataFrame([("1", "p", "p", T(5)), ("2", "p", None, T(3)), ("3", "q", None, T(2)), ("4", None, None, T(5)), ("5", "q", None, None)], "id string, track_id string, provider_album_id string, added_at timestamp_ntz")
    got = {(x["src_field"], x["row_key"]) for x in r.dangling_references(artists, empty(shape.format("album_id")), tracks, credits, items).collect()}
    assert got == {("artist_id", "1/t/0/a"), ("artist_id", "i/2/t/0/a"), ("provider_album_id", "1"), ("track_id", "2"), ("track_id", "5")}
