import random
from collections import Counter
from itertools import combinations

import pytest

from cadastra.llm import packing


def one_by_one(sizes, capacity):
    """The same method container by container: the fullest subset of what is left, the longest items first."""
    left, bins = sorted(sizes, reverse=True), 0
    while left:
        best = max((c for k in range(1, len(left) + 1) for c in combinations(left, k) if sum(c) <= capacity), key=lambda c: (sum(c), c))
        for x in best:
            left.remove(x)
        bins += 1
    return bins


def test_plan_against_container_by_container():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randint(3, 14)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        assert packing.slack_plan(Counter(sizes), capacity).containers == one_by_one(sizes, capacity)


def checked(spark, sizes, capacity, **more):
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "id int, n int, container int").repartition(4)
    rows = packing.pack(df, "id", "n", capacity, **more).collect()
    load, parts = Counter(), {}
    for r in rows:
        load[r["container"]] += r["length"]
        parts.setdefault(r["id"], []).append((r["part"], r["start"], r["length"]))
    assert all(v <= capacity for v in load.values())
    assert sorted(load) == list(range(len(load)))
    assert set(parts) == {i for i, s in enumerate(sizes) if s and s > 0}
    for i, own in parts.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and len(own) == -(-sizes[i] // capacity)
        assert [s for _, s, _ in own] == [sum(x[2] for x in own[:k]) for k in range(len(own))] and sum(x[2] for x in own) == sizes[i]
    return len(load)


def test_every_item_whole_in_one_container(spark):
    rng = random.Random(1)
    sizes = [rng.choice([1, 5, 33, 60, 99, 100, 101, 250, 0, None, -4]) for _ in range(900)] + [40] * 700
    n = checked(spark, sizes, 100)
    assert n <= -(-sum(s for s in sizes if s and s > 0) // 100) * 1.35
    assert checked(spark, sizes, 100, buckets=1) == n


def test_small_inputs(spark):
    assert checked(spark, [], 10) == 0
    assert checked(spark, [None, 0], 10) == 0
    assert checked(spark, [10], 10) == 1
    assert checked(spark, [7, 7, 3, 3], 10) == 2
    assert checked(spark, [1], 1) == 1


def test_lengths_and_report(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None), (4, "x" * 50_000)], "doc_id int, text string")
    sizes = packing.token_lengths(df)
    got = {r["doc_id"]: r["n_tokens"] for r in sizes.collect()}
    assert set(got) == {1, 4} and got[1] == 3
    report = packing.fill_report(packing.pack(sizes, "doc_id", "n_tokens", 1000), 1000).first()
    assert report["n_tokens"] == sum(got.values()) and report["largest"] <= 1000


@pytest.mark.parametrize("capacity", [1, 2, 7, 64])
def test_sums_by_bit_sets(capacity):
    mask = (1 << capacity + 1) - 1
    for length in range(1, capacity + 1):
        for count in range(0, 9):
            want = sum({1 << k * length for k in range(count + 1) if k * length <= capacity})
            assert packing.extend(1, length, count, mask) == want
