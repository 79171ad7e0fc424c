import random

from cadastra.operators.ranks import with_group_position, with_position


def test_positions_over_ranges(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 10**9) for _ in range(2000)]
    df = spark.createDataFrame([(v, "x") for v in values], "v bigint, position string").repartition(7)
    got = {r["v"]: r["n"] for r in with_position(df, ["v"], "n").collect()}
    assert [got[v] for v in sorted(set(values))] and sorted(got, key=got.get) == sorted(set(values))
    assert with_position(df.where("false"), ["v"]).count() == 0


def test_group_positions_with_a_hot_group_and_null_groups(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 11}", i * 7919 % 10007) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    want = sorted(((g or "", v, n + 1) for g, vs in by.items() for n, v in enumerate(sorted(vs))))
    assert sorted((r["g"] or "", r["v"], r["n"]) for r in with_group_position(df, ["g"], ["v"], "n").collect()) == want


def test_neighbours_over_ranges(spark):
    import datetime as dt
    import random

    from cadastra.operators.journal import nearest_around

    rng, at = random.Random(3), lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = lambda n: [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), at(rng.randrange(60))) for _ in range(n)]
    events, marks = rows(80), rows(150)
    got = {tuple(r) for r in nearest_around(*(spark.createDataFrame(x, "key string, at timestamp_ntz").repartition(3) for x in (events, marks)), "key").collect()}
    want = {(k, t, max((e for x, e in events if x == k and e <= t), default=None), min((e for x, e in events if x == k and e >= t), default=None)) for k, t in marks}
    assert got == want
