import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm import copies

FIELDS = "id string, principal string, kind string, title string, artist string, album string, album_key string, note string"
ARGS = ("id", ["principal", "kind"], ["title", "artist", "album"], ["album_key"])


def reduced(text):
    return "".join(c for c in text.lower() if unicodedata.category(c)[0] in "LMN")


def brute(rows):
    sets = {}
    for i, principal, kind, title, artist, album, key, _ in rows:
        if i is not None:
            values = [title, artist, album] + (key.split("::") if key is not None else [])
            content = frozenset(reduced(v) for v in values if v is not None) - {""}
            sets.setdefault((principal, kind, content), set()).add(i)
    return {(min(ids), other) for ids in sets.values() for other in ids if other != min(ids)}, sorted((min(ids), len(ids)) for ids in sets.values())


CASES = [
    ("a", "p", "track", "Blue  Moon", "The Band", None, None, "x"),
    ("b", "p", "track", "the band", "BLUE MOON!", "", None, "y"),
    ("c", "p", "track", None, None, None, "the-band::blue moon", None),
    ("c", "p", "track", None, None, None, "the-band::blue moon", None),
    ("d", "p", "album", "Blue Moon", "The Band", None, None, None),
    ("e", "q", "track", "Blue Moon", "The Band", None, None, None),
    ("f", "p", "track", "Blué Moon", "The Band", None, None, None),
    ("g", None, None, None, None, None, None, None),
    ("h", None, None, "", " ", "!!", "::", None),
    (None, "p", "track", "Blue Moon", "The Band", None, None, None),
    ("i", "p", "track", "x" * 200_000, "", None, None, None),
    ("j", "p", "track", "X" * 200_000 + ".", None, None, None, None),
    ("k", "p", "track", "Blue Moon 2", "The Band", None, None, None),
]


@pytest.mark.parametrize("sizes", [{}, {"segment_bits": 1 << 5, "range_segments": 2}, {"segment_bits": 1 << 6, "range_segments": 1}])
def test_pairs_and_counts(spark, sizes):
    df = spark.createDataFrame(CASES, FIELDS).repartition(5)
    pairs, counts = brute(CASES)
    assert {tuple(r) for r in copies.formatting_copies(df, *ARGS, **sizes).collect()} == pairs
    assert sorted((r["keep_id"], r["n_copies"]) for r in copies.collapsed(df, *ARGS, **sizes).collect()) == counts


def test_hot_group_and_random_rows(spark):
    rng = random.Random(3)
    words = ["Moon", "moon!", "MOON", "Sun", "sun ", "Star"]
    rows = [(f"id{i:05}", rng.choice("pq"), "track", rng.choice(words), rng.choice(words), None, None, None) for i in range(1500)]
    rows += [(f"hot{i:05}", "p", "track", "Same" + " " * (i % 7), "thing", None, None, None) for i in range(800)]
    df = spark.createDataFrame(rows, FIELDS)
    pairs, counts = brute(rows)
    assert {tuple(r) for r in copies.formatting_copies(df, *ARGS).collect()} == pairs
    assert sorted((r["keep_id"], r["n_copies"]) for r in copies.collapsed(df, *ARGS).collect()) == counts


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert copies.formatting_copies(empty, *ARGS).count() == 0
    assert copies.collapsed(empty, *ARGS).count() == 0
    clash = spark.createDataFrame([("a", "p", "t", "x", 1, 2), ("b", "p", "t", "X", 3, 4)], "id string, principal string, kind string, title string, keep_id int, n_copies int")
    assert [tuple(r) for r in copies.formatting_copies(clash, "id", ["principal", "kind"], ["title"]).collect()] == [("a", "b")]


def test_random_rows_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [(f"id{i:05}", "p", "track", f"title {rng.randrange(900)}{rng.choice(['', ' ', '!'])}", None, None, None, None) for i in range(1500)]
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    pairs, counts = brute(rows)
    sizes = {"segment_bits": 1 << 10, "range_segments": 3}
    assert copies.n_segments(1500, 1 << 10) > 9
    assert {tuple(r) for r in copies.formatting_copies(df, *ARGS, **sizes).collect()} == pairs
    assert sorted((r["keep_id"], r["n_copies"]) for r in copies.collapsed(df, *ARGS, **sizes).collect()) == counts


def passed(spark, n, repeats, segment_bits=1 << 13, range_segments=4):
    """(repeats not found, share of singletons that pass) for n distinct hashes of which the first `repeats` come twice."""
    hashes = spark.range(n).unionByName(spark.range(repeats)).select(F.xxhash64("id").alias("h")).repartition(8)
    segments = copies.n_segments(n + repeats, segment_bits)
    filters = copies.filter_segments(hashes, segments, True, segment_bits).cache()
    values = np.array([r["h"] for r in spark.range(n).select(F.xxhash64("id").alias("h")).collect()], np.int64).view(np.uint64)
    found = np.zeros(n, bool)
    for number in range(-(-segments // range_segments)):
        found |= copies.Range(filters, number, segments, segment_bits, range_segments).has(values)
    filters.unpersist()
    return int((~found[:repeats]).sum()), float(found[repeats:].mean())


def test_the_share_of_singletons_that_pass_does_not_grow(spark):
    shares = []
    for n in (2_000, 20_000, 200_000):
        missed, share = passed(spark, n, n // 10)
        assert missed == 0
        shares.append(share)
    assert max(shares) < 0.02 and abs(shares[-1] - shares[1]) < 0.005


def test_segments_in_the_jvm_and_in_batches_agree(spark):
    rows = spark.range(500).select(F.xxhash64("id").alias("h")).withColumn("s", copies.segment_of(F.col("h"), 37)).collect()
    assert copies._segment(np.array([r["h"] for r in rows], np.int64).view(np.uint64), 37).tolist() == [r["s"] for r in rows]
